"""Queries that write to the shared folder and read back: sources and sinks, with the SQL of what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..sources import records as R
from ..sources.session import scratch, table
from . import stages
from .decisions import P, pairs
from .registry import query


def _businesses(spark, d):
    """Customers as raw business records: all text, some of it empty, one name like a missing value."""
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.lit("NA")).otherwise(F.col("c_name"))
    address = F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(' "'), F.col("c_nationkey").cast("string"), F.lit('" st')))
    return c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("entity_id"), name.alias("business_name"), address.alias("business_address"), F.col("c_nationkey").cast("string").alias("country"))


BUSINESSES = """b AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS entity_id, CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE c_name END AS business_name,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || ' "' || c_nationkey || '" st' END AS business_address, c_nationkey::VARCHAR AS country FROM customer)"""


@query("io_tsv", f"WITH {BUSINESSES} SELECT * FROM b")
def io_tsv(spark, d):
    """IO1, IO2: text as it was written: leading zeros, quotes, NA and empty fields."""
    path = scratch(spark, "tsv")
    R.write_tsv(_businesses(spark, d), path)
    return R.read_tsv(spark, path)


@query("io_parquet", f"WITH {BUSINESSES} SELECT entity_id, business_name FROM b WHERE country = '7'")
def io_parquet(spark, d):
    """IO3, IO4, IO7, IO8: two columns of one country; the country is a folder, so only its files are read."""
    path = scratch(spark, "parquet")
    R.write_parquet(_businesses(spark, d).withColumnRenamed("country", "country_key"), path, 100, "country_key")
    return R.read_parquet(spark, path, ["entity_id", "business_name"], "7")


@query("io_ids", f"WITH {BUSINESSES} SELECT * FROM b WHERE entity_id IN (SELECT lpad(o_custkey::VARCHAR, 9, '0') FROM orders WHERE o_totalprice > 300000)")
def io_ids(spark, d):
    """IO5, J11: the rows of given ids."""
    ids = table(spark, d, "orders").where("o_totalprice > 300000").select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("id"))
    return R.rows_with_ids(_businesses(spark, d), ids)


@query("io_range", f"WITH {P} SELECT s1, m, prob FROM p WHERE prob >= 0.9")
def io_range(spark, d):
    """IO6: stored predictions above a probability; the bound reaches the scan of the file."""
    path = scratch(spark, "pred")
    R.write_parquet(pairs(spark, d).select("s1", "m", "prob"), path)
    return R.read_range(spark, path, "prob", 0.9)


@query("io_pool", "SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def io_pool(spark, d):
    """IO11: sources united by column name, whatever their order."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"))
    return R.pool(c, s)


@query("io_truth", f"WITH {P} SELECT DISTINCT s1::VARCHAR AS s1, m::VARCHAR AS m FROM p WHERE returned = 1")
def io_truth(spark, d):
    """IO9, IO10, IO12: lists written as text and read as pairs."""
    path = scratch(spark, "lists")
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("s1"))
    R.write_tsv(R.match_lists(e, pairs(spark, d).where("returned = 1")), path)
    schema = "source1_entity_id string, matched_entity_ids string"
    return R.truth_pairs(spark.read.csv(path, sep="\t", header=True, schema=schema, quote=""))


@query("run_fresh", "SELECT * FROM (VALUES ('first', 'prepared', true), ('first', 'counted', true), ('again', 'prepared', false), ('again', 'counted', false), ('changed', 'prepared', false), ('changed', 'counted', true), ('redone', 'prepared', true), ('redone', 'counted', true)) AS r(run, stage, ran)")
def run_fresh(spark, d):
    """O1, O2: which stages run at first, when nothing has changed, after a parameter has, and when one is to be redone."""
    root, said = scratch(spark, "run"), []

    def pipeline(share: int) -> list[stages.Stage]:
        prepared = lambda s, t: table(s, d, "orders").select(F.col("o_orderkey").alias("s1")).withColumn("fold", A.fold(F.col("s1"), by_hash=False))
        counted = lambda s, t: t["prepared"].where(F.col("s1") % 100 < share).groupBy("fold").count()
        return [stages.Stage("prepared", prepared, (), {"tables": d}), stages.Stage("counted", counted, ("prepared",), {"share": share})]

    for name, share, redo in (("first", 50, None), ("again", 50, None), ("changed", 60, None), ("redone", 60, "prepared")):
        stages.run(spark, pipeline(share), root, redo, lambda line, name=name: said.append((name, line.split(":")[0], not line.endswith("fresh"))))
    return spark.createDataFrame(said, "run string, stage string, ran boolean")
