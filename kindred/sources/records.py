"""Record sources and sinks (IO1-IO13) and the linkage roles that the driver's tables play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import prepare
from .session import spread, table

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
#: Sources of documents that play source 1, and those whose pool records count as source 3.
FIRST_SOURCES = ("src0", "src5", "src10", "src15")
THIRD_SOURCES = tuple(f"src{i}" for i in range(20) if i % 5 in (3, 4))
NAME_WORDS = 8


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """IO1, IO2: all text, no quoting, NA is a word, blanks are empty strings; splittable, so of any size."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", nullValue="\0", emptyValue="", enforceSchema=False)
    return df.fillna("")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, country: str | None = None) -> DataFrame:
    """IO3, IO4: column pruning and an equality that reaches the scan."""
    df = spark.read.parquet(path)
    df = df if country is None else df.where(F.col("country_key") == country)
    return df if columns is None else df.select(*columns)


def read_range(spark: SparkSession, path: str, column: str, low: float, columns: list[str] | None = None) -> DataFrame:
    """IO6: rows of stored predictions at or above a bound, which reaches the scan."""
    df = spark.read.parquet(path).where(F.col(column) >= low)
    return df if columns is None else df.select(*columns)


def rows_with_ids(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """IO5: the rows of given ids, as a semi-join whose side the planner broadcasts only if it is small."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 2_000_000, partition: str | None = None) -> None:
    """IO7, IO8: committed as a whole, zstd, files of bounded size, a folder per country if asked."""
    out = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(partition) if partition else out).parquet(path)


def pool(*sources: DataFrame) -> DataFrame:
    """IO11: the union of the pool sources by column name."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def truth_pairs(df: DataFrame, entity: str = "source1_entity_id", matches: str = "matched_entity_ids") -> DataFrame:
    """IO12: (s1, m) from comma lists; ids trimmed, blanks left out, each pair once."""
    m = F.explode(F.transform(F.split(F.coalesce(F.col(matches), F.lit("")), ","), lambda x: F.trim(x)))
    return df.select(F.trim(entity).alias("s1"), m.alias("m")).where("m <> ''").distinct()


def match_lists(entities: DataFrame, pairs: DataFrame, order: str = "m") -> DataFrame:
    """IO9, IO10: (source1_entity_id, matched_entity_ids), one row per entity, lists joined by commas, empty where there is none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order, "m") if order != "m" else F.struct("m"))), lambda x: x["m"].cast("string")), ",").alias("l"))
    return entities.select(F.col("s1")).join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce("l", F.lit("")).alias("matched_entity_ids"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated UTF-8 with a header, no quoting, one folder committed as a whole."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", lineSep="\n")


def text_records(rows: DataFrame) -> DataFrame:
    """rows with a business_name, the first words of `text`, and a business_address, all others, in its place."""
    ws = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    d = rows.withColumn("_w", ws)
    d = d.withColumn("business_name", F.array_join(F.slice("_w", 1, NAME_WORDS), " "))
    return d.withColumn("business_address", F.array_join(F.slice("_w", NAME_WORDS + 1, F.greatest(F.size("_w"), F.lit(1))), " ")).drop("_w", "text")


def _document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entity_id, text, country, side and is_s3."""
    df = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    side = F.when(F.col("source").isin(*FIRST_SOURCES), 1).otherwise(2).alias("side")
    return df.select(F.col("doc_id").alias("entity_id"), "text", F.col("lang").alias("country"), side, F.col("source").isin(*THIRD_SOURCES).alias("is_s3"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as business records: name the first words, address all others, country the language; side by source."""
    return text_records(_document_roles(spark, sf_dir)).select("entity_id", "business_name", "business_address", "country", "side", "is_s3")


def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prepare(document_records(...)) without the texts themselves, in one pass."""
    return prepare(_document_roles(spark, sf_dir), "text", NAME_WORDS)


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, m): records across the sides with equal texts in one language; a pool record belongs to its lowest source-1 record."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("h"), F.col("source").isin(*FIRST_SOURCES).alias("first"))
    owner = d.where("first").groupBy("lang", "h").agg(F.min("doc_id").alias("s1"))
    return d.where("NOT first").join(owner, ["lang", "h"]).select("s1", F.col("doc_id").alias("m"))
