"""Session and table access shared by every query."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "kindred", cores: str | int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, as of a small file with few row groups, is dealt to all; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only in local mode, where there is one machine, is it made up."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not re.match(r"local(\[[^]]*\])?$", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "kindred-checkpoints"))
    return named or os.path.dirname(context.getCheckpointDir())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, on whatever file system that is; it is deleted when this process ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(delete)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared checkpoint folder from then on; lost executors lose nothing of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in a session's Python workers: sends it once, unless PYTHONPATH has it already."""
    import kindred

    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(kindred.__file__))
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(context, "_kindred_shipped", False) or os.path.realpath(os.path.dirname(root)) in paths:
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "kindred.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("kindred", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._kindred_shipped = True
