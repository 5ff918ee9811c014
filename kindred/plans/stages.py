"""Running stages in order (O1-O4): skip what is fresh, redo from a stage on, record what was done.

A stage is fresh if its output is complete and its manifest has the fingerprint that its parameters and the
fingerprints of its inputs give. That replaces comparing modification times, which object stores don't keep reliably.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    """name, what makes its DataFrame from (spark, inputs by name), names of earlier stages it reads, parameters, country partitions."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    reads: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    partition: str | None = None


def fingerprint(stage: Stage, inputs: list[str]) -> str:
    return hashlib.sha256(json.dumps([stage.name, sorted(stage.parameters.items()), inputs], default=str).encode()).hexdigest()


def recorded(spark: SparkSession, folder: str) -> str | None:
    """The fingerprint of the output in a folder, or None; a manifest is written after its output is committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.text(f"{folder}/manifest").collect()
    return json.loads(rows[0][0])["fingerprint"] if rows else None


def set_aside(spark: SparkSession, folder: str) -> None:
    """O3: what a folder has is kept beside it as FOLDER.before, in place of what was there."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    old, kept = make(folder), make(f"{folder}.before")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(kept, True)
        fs.rename(old, kept)


def run(spark: SparkSession, stages: list[Stage], root: str, redo: str | None = None, say: Callable[[str], None] = print) -> dict[str, DataFrame]:
    """Runs stages under a folder and returns their tables; `redo` names a stage that runs with all after it, fresh or not.

    A stage that runs again first sets aside what it made before. A stage that fails ends the run: no later one starts, and
    its manifest, written last, is missing, so the next run begins with it.
    """
    done: dict[str, DataFrame] = {}
    prints: dict[str, str] = {}
    forced = False
    for s in stages:
        forced = forced or s.name == redo
        own = fingerprint(s, [prints[r] for r in s.reads])
        folder = f"{root}/{s.name}"
        if forced or recorded(spark, folder) != own:
            set_aside(spark, folder)
            out = s.make(spark, {r: done[r] for r in s.reads}).write.mode("overwrite").option("compression", "zstd")
            (out.partitionBy(s.partition) if s.partition else out).parquet(f"{folder}/data")
            record = {"fingerprint": own, "parameters": s.parameters, "rows": spark.read.parquet(f"{folder}/data").count()}
            spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
            say(f"{s.name}: {record['rows']} rows")
        else:
            say(f"{s.name}: fresh")
        prints[s.name] = own
        done[s.name] = spark.read.parquet(f"{folder}/data")
    return done


def all_there(spark: SparkSession, paths: list[str]) -> bool:
    """A feature source is used only if all of its files are there."""
    conf = spark._jsc.hadoopConfiguration()
    make = spark._jvm.org.apache.hadoop.fs.Path
    return all((p := make(x)).getFileSystem(conf).exists(p) for x in paths)


def linkage_stages(sf_dir: str, tau: float = 0.02, miss: float = 0.02, max_df: int = 5000) -> list[Stage]:
    """Documents as records from normalisation to match lists, all countries in one plan."""
    from pyspark.sql import functions as F

    from ..operators import blocking, decide, features, metrics, model
    from ..sources import records

    def cascade(spark, t):
        return model.cascade(t["features"], records.document_truth(spark, sf_dir), lambda kept: features.second_stage(kept, t["prepared"]), features.second_columns, tau)[0]

    def matches(spark, t):
        p = t["scored"].select(F.col("s1_id").alias("s1"), F.col("cand_id").alias("m"), "prob")
        entities = t["prepared"].where("side = 1").select(F.col("entity_id").alias("s1"))
        return records.match_lists(entities, decide.expected_f(decide.one_to_one(p), miss))

    def report(spark, t):
        """Of each part of the entities, macro F0.5 of the decision; of both stages, logloss and accuracy."""
        scored = t["scored"].withColumnsRenamed({"s1_id": "s1", "cand_id": "m"})
        entities = t["prepared"].where("side = 1").select(F.col("entity_id").alias("s1"), model.part_of(F.col("entity_id")).alias("part"))
        per = metrics.entity_table(decide.expected_f(decide.one_to_one(scored), miss), records.document_truth(spark, sf_dir), entities)
        out = per.groupBy("part").agg(F.avg("f").alias("value")).select("part", F.lit("macro F0.5").alias("figure"), "value")
        for column in ("p1", "prob"):
            for part in (*model.HALVES, model.STOP, model.UNTOUCHED):
                q = model.fit_quality(scored.where(F.col("part") == part), column)
                for figure in ("pairs", "logloss", "accuracy"):
                    out = out.unionByName(q.select(F.lit(part).alias("part"), F.lit(f"{figure} of {column}").alias("figure"), F.col(figure).cast("double").alias("value")))
        return out.coalesce(1)

    return [
        Stage("prepared", lambda spark, t: records.prepared_documents(spark, sf_dir), (), {"tables": sf_dir}),
        Stage("candidates", lambda spark, t: blocking.candidates(blocking.weighted(t["prepared"], max_df=max_df)), ("prepared",), {"max_df": max_df}, "country_key"),
        Stage("features", lambda spark, t: features.build(t["candidates"], t["prepared"]), ("prepared", "candidates"), {"strings": True}),
        Stage("scored", cascade, ("prepared", "features"), {"tau": tau}),
        Stage("matches", matches, ("prepared", "scored"), {"miss": miss}),
        Stage("report", report, ("prepared", "scored"), {"miss": miss}),
    ]


def main(args: list[str]) -> None:
    """python -m kindred.plans.stages TABLES FOLDER [--redo STAGE]"""
    from ..sources.session import local_session, ship

    spark = local_session()
    ship(spark)
    done = run(spark, linkage_stages(args[0]), args[1], args[args.index("--redo") + 1] if "--redo" in args else None)
    done["report"].orderBy("figure", "part").show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
