"""Queries over deterministic pair probabilities: decisions, metrics, error analysis, outputs, checks; with their DuckDB SQL.

Orders play source-1 entities (country: the order's priority), parts the pool, lines the candidate pairs. The true
owner of a part is the lowest order that returned it. Probabilities are arithmetic on the two keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import BUCKET, register
from ..operators import analysis as A
from ..operators import decide as D
from ..operators import metrics as M
from ..operators.features import compared
from ..operators.model import fit_quality
from ..sources import records as R
from ..sources.session import cut, table
from .registry import query


def chance(a: int, b: int):
    return (F.pmod(F.col("s1") * a + F.col("m") * b, F.lit(1000)) + 0.5) / 1000


def entities(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderpriority").alias("country"))


def pairs(spark, d) -> DataFrame:
    """s1, m, country, returned, prob, p1."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("m")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    return lines.join(entities(spark, d), "s1").withColumns({"prob": chance(7919, 104729), "p1": chance(31, 17)}).select("s1", "m", "country", "returned", "prob", "p1")


def truth(p: DataFrame) -> DataFrame:
    return p.where("returned = 1").groupBy("m").agg(F.min("s1").alias("s1")).select("s1", "m")


P = """ent AS (SELECT o_orderkey AS s1, o_orderpriority AS country FROM orders),
p AS (SELECT *, ((s1 * 7919 + m * 104729) % 1000 + 0.5) / 1000 AS prob, ((s1 * 31 + m * 17) % 1000 + 0.5) / 1000 AS p1
  FROM (SELECT l_orderkey AS s1, l_partkey AS m, max((l_returnflag = 'R')::INT) AS returned FROM lineitem GROUP BY ALL) JOIN ent USING (s1)),
tr AS (SELECT min(s1) AS s1, m FROM p WHERE returned = 1 GROUP BY m)"""
ONE = "(SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY prob DESC, s1) AS r FROM {src}) WHERE r = 1)"


def expected_sql(src: str, miss: float = 0.02, by: str = "") -> str:
    """Pairs of src that the expected-F rule keeps."""
    part = f"{by}s1"
    return f"""(SELECT * FROM (SELECT *, arg_max(k, (f, -k)) OVER (PARTITION BY {part}) AS bk, max(f) OVER (PARTITION BY {part}) AS bf FROM (
  SELECT *, 1.25 * cum / (k + 0.25 * tot * {1 + miss}) AS f, exp(lg) * exp(-{miss} * tot) AS f0 FROM (
  SELECT *, row_number() OVER w AS k, sum(pc) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(pc) OVER (PARTITION BY {part}) AS tot, sum(ln(1 - pc)) OVER (PARTITION BY {part}) AS lg
  FROM (SELECT *, least(greatest(prob, 1e-6), 1 - 1e-6) AS pc FROM {src}) WINDOW w AS (PARTITION BY {part} ORDER BY prob DESC, m)))) WHERE bf > f0 AND k <= bk)"""


def per_entity_sql(pred: str, name: str = "per") -> str:
    """`per` (s1, country, n_pred, n_true, tp, f) of all entities."""
    return f"""{name} AS (SELECT s1, country, coalesce(np, 0) AS n_pred, coalesce(nt, 0) AS n_true, coalesce(nh, 0) AS tp,
  CASE WHEN coalesce(np, 0) = 0 AND coalesce(nt, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(nh, 0) / (coalesce(np, 0) + 0.25 * coalesce(nt, 0)) END AS f FROM ent
  LEFT JOIN (SELECT s1, count(*) AS np FROM {pred} GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS nt FROM tr GROUP BY s1) USING (s1)
  LEFT JOIN (SELECT s1, count(*) AS nh FROM {pred} JOIN tr USING (s1, m) GROUP BY s1) USING (s1))"""


CHOSEN = f"one AS {ONE.format(src='p')}, pred AS (SELECT s1, m, prob, country FROM {expected_sql('one')})"


def chosen(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs, predictions and truth; pairs and predictions are used several times, so they are cut."""
    p = cut(pairs(spark, d))
    return p, cut(D.expected_f(D.one_to_one(p))), truth(p)


def graded(spark, d) -> DataFrame:
    _, pred, tr = chosen(spark, d)
    return M.entity_table(pred, tr, entities(spark, d))


@query("one_to_one", f"WITH {P} SELECT s1, m, prob FROM {ONE.format(src='p')}")
def one_to_one(spark, d):
    return D.one_to_one(pairs(spark, d)).select("s1", "m", "prob")


@query("decide_threshold", f"WITH {P}, one AS {ONE.format(src='p')} SELECT s1, m, prob FROM one WHERE prob >= 0.5")
def decide_threshold(spark, d):
    return D.threshold_then_one_to_one(pairs(spark, d), 0.5).select("s1", "m", "prob")


@query("decide_expected_f", f"WITH {P}, {CHOSEN} SELECT s1, m, prob FROM pred")
def decide_expected_f(spark, d):
    return D.expected_f(D.one_to_one(pairs(spark, d))).select("s1", "m", "prob")


@query("sharpen_unseen", f"WITH {P} SELECT s1, m, country, round(CASE WHEN country = '5-LOW' THEN prob ** 5 ELSE prob END, 6) AS prob FROM p")
def sharpen_unseen(spark, d):
    p = pairs(spark, d)
    seen = p.select("country").distinct().where("country <> '5-LOW'")
    return D.sharpen(p, seen).select("s1", "m", "country", F.round("prob", 6).alias("prob"))


def _grid_sql(values) -> str:
    return "(SELECT unnest([" + ", ".join(map(str, values)) + "]::DOUBLE[]) AS t)"


SWEEP = (0.40, 0.50, 0.60, 0.70, 0.77, 0.85, 0.90, 0.93, 0.96)


@query("threshold_sweep", f"WITH {P}, one AS {ONE.format(src='p')}, h AS (SELECT prob, (tr.m IS NOT NULL)::BIGINT AS hit FROM one LEFT JOIN tr USING (s1, m)) SELECT t, count(*) AS n_pred, sum(hit)::BIGINT AS tp FROM {_grid_sql(SWEEP)} JOIN h ON prob >= t GROUP BY t")
def threshold_sweep(spark, d):
    p = pairs(spark, d)
    return D.threshold_scores(D.one_to_one(p), truth(p), list(SWEEP)).select("t", "n_pred", "tp")


@query(
    "threshold_best",
    f"WITH {P}, h AS (SELECT prob, (tr.m IS NOT NULL)::BIGINT AS hit FROM p LEFT JOIN tr USING (s1, m)), s AS (SELECT t, count(*) AS n_pred, sum(hit)::BIGINT AS tp FROM {_grid_sql(D.MODEL_GRID)} JOIN h ON prob >= t GROUP BY t) SELECT t, round(1.25 * tp / (n_pred + 0.25 * (SELECT count(*) FROM tr)), 6) AS f05, n_pred, tp FROM s ORDER BY f05 DESC, t LIMIT 1",
)
def threshold_best(spark, d):
    p = pairs(spark, d)
    t = truth(p)
    return D.best_threshold(D.threshold_scores(p, t, D.MODEL_GRID), t.agg(F.count("*").alias("n_true")))


BEST_BY = f"""h AS (SELECT country, prob, (tr.m IS NOT NULL)::BIGINT AS hit FROM p LEFT JOIN tr USING (s1, m)), nt AS (SELECT country, count(*) AS n_true FROM tr JOIN ent USING (s1) GROUP BY country),
s AS (SELECT country, t, count(*) AS n_pred, sum(hit)::BIGINT AS tp FROM {_grid_sql(D.MODEL_GRID)} JOIN h ON prob >= t GROUP BY ALL),
best AS (SELECT country, t, f05, n_pred, tp FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY f05 DESC, t) AS r FROM (SELECT s.*, round(1.25 * tp / (n_pred + 0.25 * n_true), 6) AS f05 FROM s JOIN nt USING (country))) WHERE r = 1)"""


def _best_by(p: DataFrame, t: DataFrame, ent: DataFrame) -> DataFrame:
    n = t.join(ent, "s1").groupBy("country").agg(F.count("*").alias("n_true"))
    return D.best_threshold(D.threshold_scores(p, t, D.MODEL_GRID, "country"), n, "country")


@query("threshold_best_by_block", f"WITH {P}, {BEST_BY} SELECT * FROM best")
def threshold_best_by_block(spark, d):
    p = pairs(spark, d)
    return _best_by(p, truth(p), entities(spark, d))


@query("decide_by_block", f"WITH {P}, {BEST_BY} SELECT s1, m FROM p LEFT JOIN (SELECT country, t FROM best WHERE country <> '5-LOW') USING (country) WHERE prob >= coalesce(t, 0.5)")
def decide_by_block(spark, d):
    p = pairs(spark, d)
    best = _best_by(p, truth(p), entities(spark, d)).where("country <> '5-LOW'")
    return D.with_threshold(p, best, 0.5).select("s1", "m")


TAUS = ", ".join(map(str, D.PRUNES))
PRUNE = f"""d AS (SELECT p.*, tau FROM p JOIN (SELECT unnest([{TAUS}]::DOUBLE[]) AS tau) ON p1 >= tau), o AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY tau, m ORDER BY prob DESC, s1) AS r FROM d) WHERE r = 1),
e AS (SELECT tau, s1, m FROM {expected_sql("o", 0.02, "tau, ")}), taus AS (SELECT DISTINCT tau FROM d), ne AS (SELECT count(*) AS n FROM ent),
pe AS (SELECT tau, s1, count(*) AS np FROM e GROUP BY ALL), he AS (SELECT tau, s1, count(*) AS nh FROM e JOIN tr USING (s1, m) GROUP BY ALL), nt AS (SELECT s1, count(*) AS nt FROM tr GROUP BY s1),
g AS (SELECT tau, avg(CASE WHEN coalesce(np, 0) = 0 AND coalesce(nt, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(nh, 0) / (coalesce(np, 0) + 0.25 * coalesce(nt, 0)) END) AS f FROM (SELECT tau, s1 FROM taus CROSS JOIN ent) LEFT JOIN pe USING (tau, s1) LEFT JOIN he USING (tau, s1) LEFT JOIN nt USING (s1) GROUP BY tau),
sweep AS (SELECT tau, round(f, 6) AS macro_f05, round(c / n, 6) AS pairs_per_entity, k AS true_kept FROM g, ne, LATERAL (SELECT count(*) AS c, count(tr.m) AS k FROM d LEFT JOIN tr USING (s1, m) WHERE d.tau = g.tau))"""


@query("prune_sweep", f"WITH {P}, {PRUNE} SELECT * FROM sweep")
def prune_sweep(spark, d):
    p = cut(pairs(spark, d))
    return D.prune_sweep(p, truth(p), entities(spark, d))


@query("prune_choice", f"WITH {P}, {PRUNE} SELECT tau, macro_f05, pairs_per_entity, true_kept, round((SELECT macro_f05 FROM sweep ORDER BY tau LIMIT 1) - macro_f05, 6) AS loss FROM sweep WHERE round((SELECT macro_f05 FROM sweep ORDER BY tau LIMIT 1) - macro_f05, 6) <= 0.0005 ORDER BY tau DESC LIMIT 1")
def prune_choice(spark, d):
    return D.chosen_prune(prune_sweep(spark, d))


@query("sql_grouped", f"WITH {P} SELECT s1, round(exp(sum(ln(1 - prob))), 6) AS none_right FROM p GROUP BY s1")
def sql_grouped(spark, d):
    """A4 by the grouped-aggregate UDF, in SQL, a bucket of many entities at a time; the library's own plans use exp(sum(log1p))."""
    register(spark)
    pairs(spark, d).createOrReplaceTempView("kindred_pairs")
    buckets = 1 + table(spark, d, "lineitem").count() // BUCKET
    return spark.sql(f"SELECT r.key AS s1, round(r.none_right, 6) AS none_right FROM (SELECT explode(none_right_by(s1, prob)) AS r FROM kindred_pairs GROUP BY pmod(hash(s1), {buckets}))")


@query("sql_words", "SELECT p_partkey, generate_subscripts(w, 1)::INT - 1 AS place, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def sql_words(spark, d):
    """Words of names by the table function, in SQL."""
    register(spark)
    table(spark, d, "part").createOrReplaceTempView("kindred_parts")
    return spark.sql("SELECT p_partkey, place, word FROM kindred_parts, LATERAL words_of(p_name)")


@query("sql_metrics", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 4) AS jw FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def sql_metrics(spark, d):
    """A string metric by its SQL name."""
    register(spark)
    jw = lambda x, y: F.round(F.call_udf("jaro_winkler", x, y), 4)
    return compared(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_name", jw).withColumnRenamed("value", "jw")


@query("prune_sizes", f"WITH {P}, n AS (SELECT country, tau, count(DISTINCT s1) AS entities, count(*) FILTER (WHERE p1 >= tau) AS pairs FROM p, (SELECT unnest([{TAUS}]::DOUBLE[]) AS tau) GROUP BY country, tau) SELECT *, round(pairs / entities, 6) AS pairs_per_entity FROM n")
def prune_sizes(spark, d):
    return D.candidate_sizes(pairs(spark, d))


@query("metric_fit", f"WITH {P}, q AS (SELECT least(greatest(prob, 1e-6), 1 - 1e-6) AS x, prob, tr.m IS NOT NULL AS hit FROM p LEFT JOIN tr USING (s1, m)) SELECT count(*) AS pairs, round(-avg(CASE WHEN hit THEN ln(x) ELSE ln(1 - x) END), 6) AS logloss, round(avg(((prob >= 0.5) = hit)::INT), 6) AS accuracy FROM q")
def metric_fit(spark, d):
    p = pairs(spark, d)
    return fit_quality(p.join(truth(p).withColumn("_t", F.lit(1)), ["s1", "m"], "left").withColumn("label", F.coalesce("_t", F.lit(0))))


#: Models by their probability, one to one each; a tenth of the entities validates the choice, another one the chosen.
RULES = f"""vp AS (SELECT s1, CASE WHEN s1 % 10 = 0 THEN 'valA' ELSE 'valB' END AS part FROM ent WHERE s1 % 10 IN (0, 5)),
mp AS (SELECT 'first' AS model, s1, m, p1 AS prob FROM p UNION ALL SELECT 'second', s1, m, prob FROM p),
o AS (SELECT model, part, s1, m, prob FROM (SELECT *, row_number() OVER (PARTITION BY model, m ORDER BY prob DESC, s1) AS r FROM mp) JOIN vp USING (s1) WHERE r = 1),
nt AS (SELECT s1, count(*) AS nt FROM tr GROUP BY s1),
tg AS (SELECT model, part, s1, param, 'threshold' AS rule FROM vp, (SELECT DISTINCT model FROM mp), (SELECT unnest([{", ".join(map(str, D.FINAL_GRID))}]::DOUBLE[]) AS param)),
tk AS (SELECT model, part, s1, m, param, 'threshold' AS rule FROM o JOIN (SELECT unnest([{", ".join(map(str, D.FINAL_GRID))}]::DOUBLE[]) AS param) ON prob >= param),
""" + "".join(f"e{i} AS (SELECT model, part, s1, m, {x}::DOUBLE AS param, 'expected_f' AS rule FROM {expected_sql('o', x, 'model, part, ')})," for i, x in enumerate(D.MISSES)) + f"""
eg AS (SELECT model, part, s1, param, 'expected_f' AS rule FROM vp, (SELECT DISTINCT model FROM mp), (SELECT unnest([{", ".join(map(str, D.MISSES))}]::DOUBLE[]) AS param)),
ek AS ({" UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(len(D.MISSES)))}),
g AS (SELECT * FROM tg UNION ALL SELECT * FROM eg), k AS (SELECT * FROM tk UNION ALL SELECT * FROM ek),
kc AS (SELECT model, part, s1, param, rule, count(*) AS np, count(tr.m) AS nh FROM k LEFT JOIN tr USING (s1, m) GROUP BY ALL),
sc AS (SELECT model, rule, param, part, round(avg(CASE WHEN coalesce(np, 0) = 0 AND coalesce(nt, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(nh, 0) / (coalesce(np, 0) + 0.25 * coalesce(nt, 0)) END), 6) AS score FROM g LEFT JOIN kc USING (model, part, s1, param, rule) LEFT JOIN nt USING (s1) GROUP BY ALL),
wide AS (SELECT model, rule, param, max(CASE WHEN part = 'valA' THEN score END) AS "valA", max(CASE WHEN part = 'valB' THEN score END) AS "valB" FROM sc GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, rule ORDER BY "valA" DESC, param) AS r FROM wide),
rules AS (SELECT model, rule, param, "valA", "valB" FROM ranked WHERE r = 1)"""


@query("rule_scores", f"WITH {P}, {RULES} SELECT * FROM rules")
def rule_scores(spark, d):
    p = cut(pairs(spark, d))
    both = p.select("s1", "m", F.lit("first").alias("model"), F.col("p1").alias("prob")).union(p.select("s1", "m", F.lit("second"), "prob"))
    part = F.when(F.col("s1") % 10 == 0, "valA").otherwise("valB")
    validation = entities(spark, d).where("s1 % 10 IN (0, 5)").select("s1", part.alias("part"))
    return D.rule_scores(D.one_to_one(both, "model"), truth(p), validation)


@query("rule_choice", f"WITH {P}, {RULES} SELECT * FROM rules ORDER BY \"valA\" DESC, model, (rule <> 'threshold'), param LIMIT 1")
def rule_choice(spark, d):
    return D.choose(rule_scores(spark, d))


@query("stage_accepted", f"WITH {P}, {RULES}, best AS (SELECT model, max(\"valA\") AS a FROM rules GROUP BY model) SELECT prune, ((SELECT a FROM best WHERE model = 'second') - (SELECT a FROM best WHERE model = 'first') > 0.0005 OR prune > 0) AS accepted FROM (SELECT unnest([0.0, 0.02]::DOUBLE[]) AS prune)")
def stage_accepted(spark, d):
    """D15, without and with pruning."""
    best = {r["model"]: r["a"] for r in rule_scores(spark, d).groupBy("model").agg(F.max("valA").alias("a")).collect()}  # a row per model
    return spark.createDataFrame([(t, D.accept_stage(best["first"], best["second"], t)) for t in (0.0, 0.02)], "prune double, accepted boolean")


@query("split_fresh", """WITH used AS (SELECT o_orderkey AS s1 FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey AS s1 FROM orders WHERE o_orderkey NOT IN (SELECT s1 FROM used) ORDER BY o_orderkey * 104729 % 1000, o_orderkey LIMIT 300""")
def split_fresh(spark, d):
    """D3: entities that nobody trained on, the first by an order; the sample is the feature."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("s1"))
    return A.fresh(e, e.where("s1 % 3 = 0"), 300, F.col("s1") * 104729 % 1000)


@query("metric_micro", f"WITH {P}, {CHOSEN}, {per_entity_sql('pred')} SELECT country, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_true)::BIGINT AS n_true, round(sum(tp) / sum(n_pred), 6) AS precision, round(sum(tp) / sum(n_true), 6) AS recall, round(1.25 * sum(tp) / (sum(n_pred) + 0.25 * sum(n_true)), 6) AS f05 FROM per GROUP BY ROLLUP (country)")
def metric_micro(spark, d):
    return M.micro(graded(spark, d), "country")


@query("metric_macro", f"WITH {P}, {CHOSEN}, {per_entity_sql('pred')} SELECT country, count(*) AS entities, round(avg(f), 6) AS macro_f05 FROM per GROUP BY ROLLUP (country)")
def metric_macro(spark, d):
    return M.macro(graded(spark, d), "country")


@query(
    "metric_variants",
    f"""WITH {P}, {CHOSEN}, {per_entity_sql('pred')} SELECT round(1.25 * sum(tp) / (sum(n_pred) + 0.25 * sum(n_true)), 6) AS micro,
round(1.25 * sum((tp + 1) * tp / 2) / (sum((n_pred + 1) * n_pred / 2) + 0.25 * sum((n_true + 1) * n_true / 2)), 6) AS cluster_pairwise, round(avg(f), 6) AS macro_all,
round(avg(f) FILTER (WHERE n_true > 0), 6) AS macro_nonempty, round(avg((tp = n_pred AND tp = n_true)::INT), 6) AS exact_set FROM per""",
)
def metric_variants(spark, d):
    return M.variants(graded(spark, d))


LOST = "ms AS (SELECT t.s1, t.m, CASE WHEN p.m IS NULL THEN 'blocking' WHEN p.p1 < 0.05 THEN 'filtered' ELSE 'rejected' END AS reason FROM tr t LEFT JOIN p USING (s1, m) WHERE NOT EXISTS (SELECT 1 FROM pred q WHERE q.s1 = t.s1 AND q.m = t.m))"
PRUNED = f"pp AS (SELECT * FROM p WHERE p1 >= 0.05), one AS {ONE.format(src='pp')}, pred AS (SELECT s1, m, prob, country FROM {expected_sql('one')})"
#: Truth that blocking misses: the owner of each part that no line pairs it with, the order after the owner.
TRUTH2 = "tr AS (SELECT CASE WHEN m % 10 = 0 THEN s1 + 1 ELSE s1 END AS s1, m FROM tr0)"
P2 = P.replace("tr AS (", "tr0 AS (") + ", " + TRUTH2


def _errors(spark, d):
    """pairs, pruned pairs, predictions, a truth of which blocking misses some, lost pairs."""
    p = cut(pairs(spark, d))
    pruned = p.where("p1 >= 0.05")
    pred = cut(D.expected_f(D.one_to_one(pruned)))
    t = truth(p).select(F.when(F.col("m") % 10 == 0, F.col("s1") + 1).otherwise(F.col("s1")).alias("s1"), "m")
    return p, pruned, pred, cut(t)


def _gain(fix: str, pred: str) -> str:
    return f"SELECT '{fix}' AS fix, round((SELECT avg(f) FROM per_{fix}) - (SELECT avg(f) FROM per), 6) AS gain"


@query(
    "err_oracle_gains",
    f"""WITH {P2}, {PRUNED}, {LOST}, {per_entity_sql('pred')}, fa AS (SELECT s1, m FROM pred JOIN tr USING (s1, m)), fb AS (SELECT s1, m FROM pred UNION ALL SELECT s1, m FROM ms WHERE reason = 'rejected'),
fc AS (SELECT s1, m FROM pred UNION ALL SELECT s1, m FROM ms WHERE reason = 'filtered'), fd AS (SELECT s1, m FROM pred UNION ALL SELECT s1, m FROM ms WHERE reason = 'blocking'),
{per_entity_sql('fa', 'per_false_merges')}, {per_entity_sql('fb', 'per_rejected')}, {per_entity_sql('fc', 'per_filtered')}, {per_entity_sql('fd', 'per_blocking')}
"""
    + " UNION ALL ".join(_gain(f, f) for f in ("false_merges", "rejected", "filtered", "blocking")),
)
def err_oracle_gains(spark, d):
    p, pruned, pred, t = _errors(spark, d)
    known = entities(spark, d)
    inside = t.join(known.select("s1"), "s1", "left_semi")
    return A.oracle_gains(pred, inside, A.missed(pred, inside, pruned, p), known)


@query("err_missed", f"WITH {P2}, {PRUNED}, {LOST} SELECT reason, count(*) AS pairs FROM ms GROUP BY reason")
def err_missed(spark, d):
    p, pruned, pred, t = _errors(spark, d)
    return A.missed(pred, t, pruned, p).groupBy("reason").agg(F.count("*").alias("pairs"))


@query(
    "err_taxonomy",
    f"""WITH {P}, {CHOSEN}, {per_entity_sql('pred')}, k AS (SELECT f, CASE WHEN n_true = 0 AND n_pred > 0 THEN 'singleton matched' WHEN n_true > 0 AND n_pred = 0 THEN 'nothing predicted'
WHEN n_true > 0 AND tp < n_pred THEN 'false merge' WHEN n_true > 0 AND tp < n_true THEN 'match missed' ELSE 'perfect' END AS kind FROM per) SELECT kind, count(*) AS entities, round(sum(1 - f) / (SELECT count(*) FROM k), 6) AS loss FROM k GROUP BY kind""",
)
def err_taxonomy(spark, d):
    return A.loss_by_kind(graded(spark, d))


@query(
    "err_ownership",
    f"""WITH {P}, {CHOSEN}, fp AS (SELECT s1, m FROM pred WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.s1 = pred.s1 AND tr.m = pred.m)) SELECT CASE WHEN o.s1 IS NULL THEN 'nobody' WHEN e.country <> '5-LOW' THEN 'in sample' ELSE 'outside' END AS owner, count(*) AS pairs
FROM fp LEFT JOIN tr o ON o.m = fp.m LEFT JOIN ent e ON e.s1 = o.s1 GROUP BY 1""",
)
def err_ownership(spark, d):
    _, pred, t = chosen(spark, d)
    return A.false_merge_owners(pred, t, t, entities(spark, d).where("country <> '5-LOW'"))


@query(
    "err_empty_share",
    f"""WITH {P2}, {PRUNED}, {LOST}, er AS (SELECT 'false merge' AS kind, m FROM pred WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.s1 = pred.s1 AND tr.m = pred.m) UNION ALL SELECT reason, m FROM ms)
SELECT kind, count(*) AS errors, round(avg((p_size <= 5)::INT), 6) AS empty FROM er JOIN part ON p_partkey = m GROUP BY kind""",
)
def err_empty_share(spark, d):
    p, pruned, pred, t = _errors(spark, d)
    fp = pred.join(t, ["s1", "m"], "left_anti").select(F.lit("false merge").alias("kind"), "m")
    records = table(spark, d, "part").select(F.col("p_partkey").alias("m"), F.when(F.col("p_size") <= 5, "").otherwise(F.col("p_name")).alias("address"))
    return A.empty_share(fp.union(A.missed(pred, t, pruned, p).select("reason", "m")), records)


@query("err_histogram", f"WITH {P}, one AS {ONE.format(src='p')} SELECT CASE WHEN prob <= 0.05 THEN '(0, 0.05]' WHEN prob <= 0.2 THEN '(0.05, 0.2]' WHEN prob <= 0.5 THEN '(0.2, 0.5]' WHEN prob <= 0.8 THEN '(0.5, 0.8]' ELSE '(0.8, 1]' END AS bin, count(*) AS n FROM one GROUP BY 1")
def err_histogram(spark, d):
    return A.histogram(D.one_to_one(pairs(spark, d)), "prob")


EXPECTED = """ex AS (SELECT ent.s1, ent.country, CASE WHEN coalesce(k, 0) = 0 THEN exp(coalesce(lg, 0) - 0.02 * coalesce(tot, 0)) ELSE 1.25 * tp / (k + 0.25 * tot * 1.02) END AS expected FROM ent LEFT JOIN (
  SELECT one.s1, sum(one.prob) AS tot, sum(ln(1 - one.prob)) AS lg, count(pred.m) AS k, sum(CASE WHEN pred.m IS NOT NULL THEN one.prob END) AS tp FROM one LEFT JOIN pred USING (s1, m) GROUP BY one.s1) USING (s1))"""


@query("forecast_expected", f"WITH {P}, {CHOSEN}, {EXPECTED} SELECT country, count(*) AS entities, round(avg(expected), 6) AS expected FROM ex GROUP BY country")
def forecast_expected(spark, d):
    p = pairs(spark, d)
    one = cut(D.one_to_one(p))
    return M.expected_per_entity(one, D.expected_f(one), entities(spark, d)).groupBy("country").agg(F.count("*").alias("entities"), F.round(F.avg("expected"), 6).alias("expected"))


@query(
    "forecast_weighted",
    f"""WITH {P}, {CHOSEN}, {EXPECTED}, {per_entity_sql('pred')}, c AS (SELECT ex.country, avg(expected) AS e, avg(f) AS a, count(*) AS n FROM ex JOIN per USING (s1) GROUP BY ex.country),
q AS (SELECT country, n, country <> '5-LOW' AS seen, CASE WHEN country = '5-LOW' THEN least(greatest(e - 0.0632, 0), 1) ELSE a END AS part, CASE WHEN country <> '5-LOW' THEN least(greatest(e + a - e, 0), 1) - a END AS shift FROM c)
SELECT round(sum(n * part) / sum(n), 6) AS forecast, round((sum(n * part) + sum(CASE WHEN seen THEN n ELSE 0 END) * avg(shift)) / sum(n), 6) AS forecast_shifted FROM q""",
)
def forecast_weighted(spark, d):
    p = pairs(spark, d)
    one = cut(D.one_to_one(p))
    pred = cut(D.expected_f(one))
    ex = M.expected_per_entity(one, pred, entities(spark, d))
    seen = M.entity_table(pred, truth(p), entities(spark, d)).where("country <> '5-LOW'").select("s1", "country", "f").join(ex.select("s1", "expected"), "s1")
    return M.forecast(ex, seen, unseen_offset=-0.0632)


@query("write_lists", f"WITH {P}, {CHOSEN} SELECT ent.s1 AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM ent LEFT JOIN (SELECT s1, string_agg(m, ',' ORDER BY m) AS l FROM pred GROUP BY s1) USING (s1)")
def write_lists(spark, d):
    return R.match_lists(entities(spark, d), decide_expected_f(spark, d))


@query("write_probe", f"WITH {P}, one AS {ONE.format(src='p')}, pred AS (SELECT s1, m FROM one WHERE prob >= CASE WHEN country = '5-LOW' THEN 0.95 ELSE 0.77 END) SELECT ent.s1 AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM ent LEFT JOIN (SELECT s1, string_agg(m, ',' ORDER BY m) AS l FROM pred GROUP BY s1) USING (s1)")
def write_probe(spark, d):
    own = spark.createDataFrame([("5-LOW", 0.95)], "country string, t double")
    return R.match_lists(entities(spark, d), D.with_threshold(D.one_to_one(pairs(spark, d)), own, 0.77))


CHECKS = ["entity listed twice", "entity missing", "entity unknown", "match not a candidate", "match twice in a list", "record matched twice", "match unknown", "candidate unknown"]


@query("check_violations", " UNION ALL ".join(f"SELECT '{c}' AS \"check\", 0::BIGINT AS n" for c in CHECKS))
def check_violations(spark, d):
    p, pred, _ = chosen(spark, d)
    ent = entities(spark, d)
    return A.violations(R.match_lists(ent, pred), R.match_lists(ent, p.select("s1", "m")), ent.select("s1"), table(spark, d, "part").select("p_partkey"))


@query(
    "split_parts",
    """WITH e AS (SELECT o_orderkey AS s1, (o_orderkey * 7919 + 42) % 100 AS b FROM orders), f AS (SELECT s1, CASE WHEN b < 20 THEN 'val' WHEN b < 60 THEN 'enc' ELSE 'match' END AS fold FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY fold = 'val' ORDER BY s1 * 104729 % 1000, s1) AS r, count(*) OVER () AS n FROM f)
SELECT s1, fold, part FROM (SELECT s1, fold, CASE WHEN fold <> 'val' AND r <= n // 3 THEN 'train' WHEN fold = 'val' AND r <= n // 20 THEN 'valA' WHEN fold = 'val' AND r <= n // 20 * 2 THEN 'valB' END AS part FROM r) WHERE part IS NOT NULL""",
)
def split_parts(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("s1")).withColumn("fold", A.fold(F.col("s1"), by_hash=False))
    n = e.count()
    return A.parts(e, n // 3, n // 20 * 2, F.col("s1") * 104729 % 1000).select("s1", "fold", "part")


@query(
    "hard_negatives",
    f"""WITH {P}, x AS (SELECT s1, m, (tr.m IS NOT NULL)::INT AS label, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, m) - 1 AS fwd_rank, row_number() OVER (PARTITION BY p.m ORDER BY prob DESC, s1) - 1 AS rev_rank, (s1 * 31 + p.m * 17) % 1000 AS o FROM p LEFT JOIN tr USING (s1, m))
(SELECT s1, m, label FROM x WHERE label = 1 ORDER BY o, s1, m LIMIT 900) UNION ALL (SELECT s1, m, label FROM x WHERE label = 0 AND (fwd_rank < 8 OR rev_rank < 2) ORDER BY o, s1, m LIMIT 1100)""",
)
def hard_negatives(spark, d):
    from pyspark.sql import Window as W

    p = pairs(spark, d)
    x = p.join(truth(p).withColumn("_t", F.lit(1)), ["s1", "m"], "left").withColumn("label", F.coalesce("_t", F.lit(0)))
    x = x.withColumn("fwd_rank", F.row_number().over(W.partitionBy("s1").orderBy(F.col("prob").desc(), "m")) - 1).withColumn("rev_rank", F.row_number().over(W.partitionBy("m").orderBy(F.col("prob").desc(), "s1")) - 1)
    return A.training_pairs(cut(x), 2000, F.pmod(F.col("s1") * 31 + F.col("m") * 17, F.lit(1000))).select("s1", "m", "label")


@query(
    "conv_concat",
    "SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS text_digest FROM conversations GROUP BY conv_id",
)
def conv_concat(spark, d):
    c = table(spark, d, "conversations")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(joined).alias("text_digest"))
