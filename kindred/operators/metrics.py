"""Scores of accepted pairs against the truth: micro (D6), macro (D9), variants (D17), expected (D24), forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1.25 tp / (n_pred + n_true / 4); 1 if both are empty."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).otherwise(1.25 * tp / (n_pred + 0.25 * n_true))


def entity_table(pred: DataFrame, truth: DataFrame, entities: DataFrame | None, *by: str) -> DataFrame:
    """(by, s1, n_pred, n_true, tp, f), an entity per row: of `entities`, or without it those with a pair on either side.

    Predictions and truth are tagged and united, so one shuffle by entity serves counts and matches alike.
    """
    a = pred.select(*by, "s1", "m", F.lit(1).alias("p"), F.lit(0).alias("t"))
    b = truth.select(*by, "s1", "m", F.lit(0).alias("p"), F.lit(1).alias("t"))
    pair = a.union(b).groupBy(*by, "s1", "m").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    per = pair.groupBy(*by, "s1").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    if entities is not None:
        keep = [c for c in entities.columns if c not in per.columns]
        per = entities.select("s1", *keep).join(per, "s1", "left").fillna(0, ["n_pred", "n_true", "tp"])
    return per.withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def micro(per_entity: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F0.5, overall and (grouping sets) by a column."""
    n = [F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")]
    s = per_entity.rollup(*by).agg(*n) if by else per_entity.agg(*n)
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return s.select(*by, "tp", "n_pred", "n_true", r(F.col("tp"), F.col("n_pred")).alias("precision"), r(F.col("tp"), F.col("n_true")).alias("recall"), r(1.25 * F.col("tp"), F.col("n_pred") + 0.25 * F.col("n_true")).alias("f05"))


def macro(per_entity: DataFrame, *by: str) -> DataFrame:
    out = [F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f05")]
    return per_entity.rollup(*by).agg(*out) if by else per_entity.agg(*out)


def variants(per_entity: DataFrame) -> DataFrame:
    """Five readings of F0.5 from one table per entity."""
    half = lambda c, d: F.sum((F.col(c) + 1) * F.col(d) / 2)
    share = lambda tp, p, t: F.round(F.coalesce(F.try_divide(1.25 * tp, p + 0.25 * t), F.lit(0.0)), 6)
    return per_entity.agg(
        share(F.sum("tp"), F.sum("n_pred"), F.sum("n_true")).alias("micro"),
        share(half("tp", "tp"), half("n_pred", "n_pred"), half("n_true", "n_true")).alias("cluster_pairwise"),
        F.round(F.avg("f"), 6).alias("macro_all"),
        F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f"))), 6).alias("macro_nonempty"),
        F.round(F.avg(((F.col("tp") == F.col("n_pred")) & (F.col("tp") == F.col("n_true"))).cast("int")), 6).alias("exact_set"),
    )


def expected_per_entity(pairs: DataFrame, pred: DataFrame, entities: DataFrame, miss: float = 0.02, edge: float = 1e-6) -> DataFrame:
    """(entities' columns, expected): F0.5 that the probabilities promise for the chosen pairs."""
    d = pairs.join(pred.select("s1", "m", F.lit(1).alias("_c")), ["s1", "m"], "left").withColumn("_p", F.least(F.greatest(F.col("prob"), F.lit(edge)), F.lit(1 - edge)))
    per = d.groupBy("s1").agg(F.sum("_p").alias("total"), F.sum(F.log1p(-F.col("_p"))).alias("log_empty"), F.count("_c").alias("k"), F.coalesce(F.sum(F.when(F.col("_c") == 1, F.col("_p"))), F.lit(0.0)).alias("tp"))
    j = entities.join(per, "s1", "left").fillna(0, ["total", "log_empty", "k", "tp"])
    none = F.exp(F.col("log_empty") - miss * F.col("total"))
    return j.select(*entities.columns, F.when(F.col("k") == 0, none).otherwise(1.25 * F.col("tp") / (F.col("k") + 0.25 * F.col("total") * (1 + miss))).alias("expected"))


def forecast(expected: DataFrame, actual: DataFrame, unseen_offset: float = 0.0) -> DataFrame:
    """(forecast, forecast_shifted): countries' scores weighted by their entities.

    expected has country and expected, actual country and f (countries seen). A seen country counts as measured; the
    shifted forecast moves all seen ones by the mean of what the estimator, corrected for its bias, says of them. An
    unseen country counts as estimated plus the offset.
    """
    e = expected.groupBy("country").agg(F.avg("expected").alias("e"), F.count("*").alias("n"))
    a = actual.groupBy("country").agg(F.avg("f").alias("a"), F.avg("expected").alias("ae"))
    j = e.join(a, "country", "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    j = j.withColumn("part", F.coalesce("a", clip(F.col("e") + unseen_offset))).withColumn("shift", F.when(F.col("a").isNotNull(), clip(F.col("e") + F.col("a") - F.col("ae")) - F.col("a")))
    s = j.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("part")).alias("p"), F.sum(F.when(F.col("a").isNotNull(), F.col("n")).otherwise(0)).alias("seen"), F.coalesce(F.avg("shift"), F.lit(0.0)).alias("shift"))
    return s.select(F.round(F.col("p") / F.col("n"), 6).alias("forecast"), F.round((F.col("p") + F.col("seen") * F.col("shift")) / F.col("n"), 6).alias("forecast_shifted"))
