"""From pair probabilities to accepted pairs: one-to-one (D10), thresholds (D7, D8, D11), expected F0.5 (D12), sharpening (D13), pruning.

Tables: pairs (s1, m, country, prob, ...), truth (s1, m), entities (s1, ...), all keyed by columns, none collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import entity_table, f05

#: Clipping of probabilities, power for unseen countries, share of matches that blocking never retrieves and
#: the shares tried for it, prune levels and the loss they may cost.
EDGE = 1e-6
UNSEEN_POWER = 5
MISS = 0.02
MISSES = (0.0, 0.02, 0.05, 0.10)
PRUNES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
MAX_LOSS = 0.0005


def grid(low: float, high: float, step: float = 0.01) -> list[float]:
    return [round(low + i * step, 2) for i in range(round((high - low) / step) + 1)]


#: Thresholds of the model stage and of the final stage (fixed values).
MODEL_GRID, FINAL_GRID = grid(0.05, 0.95), grid(0.10, 0.96)


def one_to_one(pairs: DataFrame, *by: str) -> DataFrame:
    """Each pool record keeps its most probable entity, the lower id among equals."""
    w = W.partitionBy(*by, "m").orderBy(F.col("prob").desc(), "s1")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def threshold(pairs: DataFrame, t: float) -> DataFrame:
    return pairs.where(F.col("prob") >= t)


def threshold_then_one_to_one(pairs: DataFrame, t: float) -> DataFrame:
    """The same pairs as one_to_one and then the threshold: a record's best pair passes if any does. Filtering first shuffles less."""
    return one_to_one(threshold(pairs, t))


def expected_f(pairs: DataFrame, miss: float | Column = MISS, *by: str) -> DataFrame:
    """Per entity the first k pairs that maximise expected F0.5; no pair where none is expected to do better."""
    miss = F.lit(miss) if isinstance(miss, float) else miss
    p = F.least(F.greatest(F.col("prob"), F.lit(EDGE)), F.lit(1 - EDGE))
    entity = W.partitionBy(*by, "s1")
    order = entity.orderBy(F.col("prob").desc(), "m")
    d = pairs.withColumn("_p", p).withColumn("_k", F.row_number().over(order))
    d = d.withColumn("_cum", F.sum("_p").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_p").over(entity))
    d = d.withColumn("_f", 1.25 * F.col("_cum") / (F.col("_k") + 0.25 * F.col("_all") * (1 + miss)))
    d = d.withColumn("_none", F.exp(F.sum(F.log1p(-F.col("_p"))).over(entity)) * F.exp(-miss * F.col("_all")))
    best = F.max(F.struct("_f", (-F.col("_k")).alias("_k"))).over(entity)
    d = d.withColumn("_best", F.when(best["_f"] > F.col("_none"), -best["_k"]).otherwise(0))
    return d.where("_k <= _best").select(*pairs.columns)


def sharpen(pairs: DataFrame, seen: DataFrame, power: float = UNSEEN_POWER) -> DataFrame:
    """Probabilities of countries that `seen` (one column, country) doesn't have go to the power."""
    known = seen.select("country", F.lit(True).alias("_seen")).distinct()
    return pairs.join(known, "country", "left").withColumn("prob", F.when(F.col("_seen"), F.col("prob")).otherwise(F.pow("prob", F.lit(power)))).select(*pairs.columns)


def at_thresholds(pairs: DataFrame, values: list[float], name: str = "t", column: str = "prob") -> DataFrame:
    """A copy of each pair for every value its column reaches: a row explodes to the values below it, no join."""
    return pairs.withColumn(name, F.explode(F.filter(F.array(*map(F.lit, values)), lambda t: t <= F.col(column))))


def threshold_scores(pairs: DataFrame, truth: DataFrame, values: list[float], *by: str) -> DataFrame:
    """Pairs and true pairs accepted at each threshold, micro precision, recall and F0.5; overall or by columns.

    Pairs are counted once per step of the grid they fall in and summed up from the top, so no pair is copied.
    """
    hit = truth.select("s1", "m", F.lit(1).alias("_t"))
    step = F.size(F.filter(F.array(*map(F.lit, values)), lambda t: t <= F.col("prob")))
    d = pairs.join(hit, ["s1", "m"], "left").withColumn("_step", step)
    n = d.groupBy(*by, "_step").agg(F.count("*").alias("n"), F.count("_t").alias("tp"))
    steps = n.select(*by).distinct() if by else n.sparkSession.range(1).select()
    steps = steps.select(*by, F.posexplode(F.array(*map(F.lit, values))).alias("i", "t"))
    own = ["_step", *by]
    j = steps.withColumn("_step", F.col("i") + 1).join(n, own, "left").fillna(0, ["n", "tp"])
    down = W.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, 0)
    return j.select(*by, "t", F.sum("n").over(down).alias("n_pred"), F.sum("tp").over(down).alias("tp"))


def best_threshold(scores: DataFrame, n_true: DataFrame, *by: str) -> DataFrame:
    """The threshold of the best micro F0.5, the first of equals; n_true has the true pairs (by columns)."""
    j = scores.join(n_true, list(by)) if by else scores.join(F.broadcast(n_true))
    f = F.round(F.coalesce(F.try_divide(1.25 * F.col("tp"), F.col("n_pred") + 0.25 * F.col("n_true")), F.lit(0.0)), 6)
    w = W.partitionBy(*by).orderBy(F.col("f05").desc(), "t")
    return j.withColumn("f05", f).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "t", "f05", "n_pred", "tp")


def with_threshold(pairs: DataFrame, by_country: DataFrame, default: float) -> DataFrame:
    """Pairs at or above their country's threshold (country, t), or the default where it has none."""
    return pairs.join(by_country.select("country", F.col("t").alias("_t")), "country", "left").where(F.col("prob") >= F.coalesce("_t", F.lit(default))).select(*pairs.columns)


def prune_sweep(pairs: DataFrame, truth: DataFrame, entities: DataFrame, taus: tuple[float, ...] = PRUNES, miss: float = MISS) -> DataFrame:
    """D14 for all taus in one job: pairs of p1 >= tau, their decision's macro F0.5, pairs per entity, true pairs kept.

    An entity without pairs or truth scores 1, so it counts in every mean without being copied for each tau.
    """
    d = at_thresholds(pairs, list(taus), "tau", "p1")
    chosen = expected_f(one_to_one(d, "tau"), miss, "tau")
    per = entity_table(chosen, truth.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))), None, "tau")
    n = entities.select("s1").distinct().agg(F.count("*").alias("n_entities"))
    score = per.groupBy("tau").agg(F.sum(F.col("f") - 1).alias("lost"))
    kept = d.join(truth.select("s1", "m", F.lit(1).alias("_t")), ["s1", "m"], "left").groupBy("tau").agg(F.count("*").alias("pairs"), F.count("_t").alias("true_kept"))
    return kept.join(score, "tau").join(F.broadcast(n)).select("tau", F.round(1 + F.col("lost") / F.col("n_entities"), 6).alias("macro_f05"), F.round(F.col("pairs") / F.col("n_entities"), 6).alias("pairs_per_entity"), "true_kept")


def chosen_prune(sweep: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The largest tau whose loss against the smallest is within max_loss; sweep has a row per tau."""
    base = F.min(F.struct("tau", "macro_f05")).over(W.partitionBy())["macro_f05"]
    return sweep.withColumn("loss", F.round(base - F.col("macro_f05"), 6)).where(F.col("loss") <= max_loss).orderBy(F.col("tau").desc()).limit(1)


def accept_stage(first: float, second: float, prune: float, gain: float = 0.0005) -> bool:
    """The second stage is used if it gains enough on the first validation half, or if pruning is active."""
    return second - first > gain or prune > 0


def candidate_sizes(pairs: DataFrame, taus: tuple[float, ...] = PRUNES) -> DataFrame:
    """(country, entities, tau, pairs, pairs_per_entity): distinct entities with candidates, and the pairs that each tau leaves them."""
    n = pairs.groupBy("country").agg(F.count_distinct("s1").alias("entities"), *[F.count_if(F.col("p1") >= t).alias(f"_{i}") for i, t in enumerate(taus)])
    rows = n.select("country", "entities", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"_{i}").alias("pairs")) for i, t in enumerate(taus)])).alias("x"))
    return rows.select("country", "entities", "x.*").withColumn("pairs_per_entity", F.round(F.col("pairs") / F.col("entities"), 6))


def threshold_macro(pairs: DataFrame, truth: DataFrame, entities: DataFrame, values: list[float], *by: str) -> DataFrame:
    """(by, param, score): macro F0.5 of pairs at or above each threshold, over all of `entities` (s1, by).

    An entity's score changes only at the steps of the grid that one of its pairs falls in, so changes are summed by
    step, and steps from the top down; no pair and no entity is copied for the thresholds that it isn't at.
    """
    n_true = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    step = F.size(F.filter(F.array(*map(F.lit, values)), lambda t: t <= F.col("prob")))
    hit = pairs.join(truth.select("s1", "m", F.lit(1).alias("_t")), ["s1", "m"], "left").withColumn("_i", step - 1).where("_i >= 0")
    n = hit.groupBy(*by, "s1", "_i").agg(F.count("*").alias("n"), F.count("_t").alias("tp")).join(n_true, "s1", "left").fillna(0, ["n_true"])
    down = W.partitionBy(*by, "s1").orderBy(F.col("_i").desc())
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    f = f05(F.sum("tp").over(upto), F.sum("n").over(upto), F.col("n_true"))
    none = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    n = n.withColumn("_f", f).withColumn("_change", F.col("_f") - F.coalesce(F.lag("_f").over(down), none))
    change = n.groupBy(*by, "_i").agg(F.sum("_change").alias("_change"))
    start = entities.join(n_true, "s1", "left").groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("n_true").isNull(), 1.0).otherwise(0.0)).alias("_none"))
    grid = start.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("_i", "param"))
    every = W.partitionBy(*by).orderBy(F.col("_i").desc()).rowsBetween(W.unboundedPreceding, 0)
    d = grid.join(change, [*by, "_i"], "left").withColumn("_sum", F.sum(F.coalesce("_change", F.lit(0.0))).over(every))
    return d.select(*by, "param", F.round((F.col("_none") + F.col("_sum")) / F.col("_n"), 6).alias("score"))


def miss_macro(pairs: DataFrame, truth: DataFrame, entities: DataFrame, values: tuple[float, ...], *by: str) -> DataFrame:
    """(by, param, score): macro F0.5 of the expected-F rule for each share of matches that blocking is taken to miss."""
    every = lambda d: d.withColumn("param", F.explode(F.array(*map(F.lit, values))))
    kept = expected_f(every(pairs), F.col("param"), *by, "param")
    per = entity_table(kept, every(truth.join(entities, "s1")), None, *by, "param")
    lost = per.groupBy(*by, "param").agg(F.sum(F.col("f") - 1).alias("_lost"))
    n = every(entities.groupBy(*by).agg(F.count("*").alias("_n")))
    return n.join(lost, [*by, "param"], "left").select(*by, "param", F.round(1 + F.coalesce("_lost", F.lit(0.0)) / F.col("_n"), 6).alias("score"))


def rule_scores(pairs: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(model, rule, param, valA, valB): for each model and rule the parameter that is best on valA, the least of equals.

    pairs (s1, m, model, prob), one to one already; entities (s1, part), part valA or valB.
    """
    models = pairs.select("model").distinct()
    placed = entities.crossJoin(F.broadcast(models))  # a row per model, of which there are two
    by = ["model", "part"]
    own = pairs.join(entities, "s1")
    t = threshold_macro(own, truth, placed, FINAL_GRID, *by).withColumn("rule", F.lit("threshold"))
    m = miss_macro(own, truth, placed, MISSES, *by).withColumn("rule", F.lit("expected_f"))
    both = t.unionByName(m).groupBy("model", "rule", "param").agg(*[F.max(F.when(F.col("part") == v, F.col("score"))).alias(v) for v in ("valA", "valB")])
    w = W.partitionBy("model", "rule").orderBy(F.col("valA").desc(), "param")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def choose(rows: DataFrame) -> DataFrame:
    """The model and rule of the best score on valA; among equals the first model by name, thresholds before expected F."""
    return rows.orderBy(F.col("valA").desc(), "model", F.when(F.col("rule") == "threshold", 0).otherwise(1), "param").limit(1)
