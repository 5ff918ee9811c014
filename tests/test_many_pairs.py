"""Text metrics and grouped aggregates do their Python work once per distinct pair of texts and once per bucket, not per row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.functions import sql
from kindred.functions.similarity import jaro_winkler, jaro_winkler_udf
from kindred.operators import features

NAMES = ["red bolt", "red bolts", "blue nut", None]


@pytest.mark.parametrize("most", [700, 1])
def test_compared_is_whole_and_right(spark, monkeypatch, most):
    monkeypatch.setattr(features, "FEW_TEXTS", most)
    rows = [(k, f"g{k % 3}", k % 2, NAMES[k % 4]) for k in range(60)] + [(60, None, 0, "red bolt")]
    got = features.compared(spark.createDataFrame(rows, "k long, g string, h int, t string"), ["g", "h"], "k", "t", jaro_winkler_udf).collect()
    want = {(a[0], b[0]): None if a[3] is None or b[3] is None else jaro_winkler(a[3], b[3]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1:3] == b[1:3]}
    assert len(got) == len(want) and {(r["a"], r["b"]): r["value"] for r in got} == want


def test_compared_compares_texts_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def metric(x, y):
        @F.udf("long")
        def run(a, b):
            calls.add(1)
            return len(a) - len(b)

        return run(x, y)

    rows = spark.range(200).selectExpr("id AS k", "1 AS g", "concat('t', id % 3) AS t")
    assert features.compared(rows, ["g"], "k", "t", metric).count() == 200 * 199 // 2
    assert calls.value <= 9


def test_none_right_by_bucket(spark):
    sql.register(spark)
    spark.createDataFrame([(k % 7, None if k % 5 == 0 else k / 100) for k in range(90)], "s1 long, p double").createOrReplaceTempView("many_pairs")
    one = {r[0]: r[1] for r in spark.sql("SELECT s1, none_right(p) FROM many_pairs GROUP BY s1").collect()}
    many = {r[0]: r[1] for r in spark.sql("SELECT r.key, r.none_right FROM (SELECT explode(none_right_by(s1, p)) AS r FROM many_pairs GROUP BY s1 % 2)").collect()}
    assert many.keys() == one.keys() and all(abs(many[k] - one[k]) < 1e-12 for k in one)
