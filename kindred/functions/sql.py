"""Functions for SQL users: string metrics as Arrow UDFs, a grouped-aggregate UDF, a table function. Plans of this library don't need them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similarity


def _pairwise(kernel):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


@F.pandas_udf(T.DoubleType())
def none_right(p: pd.Series) -> float:
    """A4: the chance that none of a group's pairs is right, as a product in logarithms; nulls don't count."""
    return math.exp(sum(math.log1p(-x) for x in p.dropna().clip(1e-6, 1 - 1e-6)))


#: Rows of many groups that one call of none_right_by takes, about: a call costs much more than a row.
BUCKET = 20_000


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("none_right", T.DoubleType())])))
def none_right_by(key: pd.Series, p: pd.Series) -> list:
    """none_right of each key (an integer, not null) in a bucket of whole groups."""
    keys, which = np.unique(key.to_numpy(), return_inverse=True)
    logs = np.log1p(-p.astype("float64").clip(1e-6, 1 - 1e-6)).fillna(0.0)
    products = np.exp(np.bincount(which, logs, len(keys)))
    return [{"key": k, "none_right": v} for k, v in zip(keys.tolist(), products.tolist(), strict=True)]


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())]))
class WordsOf:
    """The words of a text with their places from 0; none for null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def register(spark: SparkSession) -> None:
    """name_ratio, token_set, token_sort, partial_ratio, jaro_winkler (a, b); none_right (p) per group, none_right_by (key, p) per bucket of groups; words_of (text) as a table."""
    for name, kernel in {"name_ratio": similarity.ratio, "token_set": similarity.token_set, "token_sort": similarity.token_sort, "partial_ratio": similarity.partial, "jaro_winkler": similarity.jaro_winkler}.items():
        spark.udf.register(name, _pairwise(kernel))
    spark.udf.register("none_right", none_right)
    spark.udf.register("none_right_by", none_right_by)
    spark.udtf.register("words_of", WordsOf)
