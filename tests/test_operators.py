"""Decisions, metrics, checks, sources and models on small hand-made tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import analysis as A
from kindred.operators import blocking as B
from kindred.operators import decide as D
from kindred.operators import features as X
from kindred.operators import metrics as M
from kindred.operators import model
from kindred.sources import records as R

PAIR = "s1 long, m long, country string, prob double"


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def test_expected_f(spark):
    p = pairs(spark, [(1, 1, "a", 0.9), (1, 2, "a", 0.2), (2, 3, "a", 0.3)])
    assert [(r["s1"], r["m"]) for r in D.expected_f(p, 0.0).collect()] == [(1, 1)]
    assert D.expected_f(pairs(spark, [])).count() == 0


def test_expected_f_beats_every_other_k(spark):
    rng = random.Random(5)
    rows = [(s, 10 * s + k, "a", rng.choice([rng.random(), 0.5, 0.999999999])) for s in range(40) for k in range(rng.randint(1, 6))]
    kept = {}
    for r in D.expected_f(pairs(spark, rows), 0.05).collect():
        kept[r["s1"]] = kept.get(r["s1"], 0) + 1
    for s in range(40):
        p = sorted((min(max(x[3], 1e-6), 1 - 1e-6) for x in rows if x[0] == s), reverse=True)
        f = [math.prod(1 - x for x in p) * math.exp(-0.05 * sum(p))] + [1.25 * sum(p[:k]) / (k + 0.25 * sum(p) * 1.05) for k in range(1, len(p) + 1)]
        assert f[kept.get(s, 0)] == pytest.approx(max(f))


def test_one_to_one_commutes_with_threshold(spark):
    rng = random.Random(6)
    p = pairs(spark, [(rng.randint(1, 20), rng.randint(1, 15), "a", round(rng.random(), 1)) for _ in range(200)]).dropDuplicates(["s1", "m"])
    for t in (0.0, 0.4, 0.9):
        assert sorted(D.threshold(D.one_to_one(p), t).collect()) == sorted(D.threshold_then_one_to_one(p, t).collect())
    kept = D.one_to_one(p)
    assert kept.count() == kept.select("m").distinct().count()


def test_sharpening_and_grids(spark):
    p = D.sharpen(pairs(spark, [(1, 1, "new", 0.95), (1, 2, "new", 0.9), (2, 3, "old", 0.9)]), spark.createDataFrame([("old",)], "country string"))
    assert sorted(round(r["prob"], 2) for r in p.collect()) == [0.59, 0.77, 0.9]
    assert (len(D.MODEL_GRID), D.MODEL_GRID[0], D.MODEL_GRID[-1]) == (91, 0.05, 0.95)
    assert (len(D.FINAL_GRID), D.FINAL_GRID[0], D.FINAL_GRID[-1]) == (87, 0.1, 0.96)
    assert D.accept_stage(0.9, 0.9006, 0) and not D.accept_stage(0.9, 0.9001, 0) and D.accept_stage(0.9, 0.8, 0.01)


def test_macro(spark):
    t = lambda rows: spark.createDataFrame(rows, "s1 long, m long")
    e = spark.createDataFrame([(1,), (2,), (3,)], "s1 long")
    per = {r["s1"]: r["f"] for r in M.entity_table(t([(1, 1), (1, 2), (1, 3), (3, 9)]), t([(1, 1), (1, 2), (1, 3), (1, 4)]), e).collect()}
    assert per == {1: 0.9375, 2: 1.0, 3: 0.0}


def test_best_other_value(spark):
    d = X.in_entity(spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.1), (2, 4, 0.5)], "s1_id long, cand_id long, p1 double"))
    got = {r["cand_id"]: (r["other_max"], r["p1_rank"], r["other_conf"]) for r in d.collect()}
    assert got == {1: (0.6, 0, 1), 2: (0.9, 1, 1), 3: (0.9, 2, 2), 4: (None, 0, 0)}


@pytest.mark.parametrize(("matches", "block"), [(4_000_000, (250, 1000)), (50, (7, 5))])
def test_candidates_equal_the_outer_join_of_both_searches(spark, monkeypatch, matches, block):
    """The block search against one join over all pairs, in one block and in many, with ties."""
    monkeypatch.setattr(B, "MATCHES", matches)
    monkeypatch.setattr(B, "LEAST_BLOCK", block)
    rng = random.Random(7)
    rows = [(c, f"t{t}", f"{c}{i}", 1 + i % 2, rng.choice([0.1, 0.2, 0.5])) for c in "xy" for i in range(70) for t in rng.sample(range(40), 6)]
    rows += [("z", "t1", "z1", 1, 0.5), ("w", "t1", "w2", 2, 0.5), ("v", "t1", "v1", 1, 0.5), ("v", "t2", "v2", 2, 0.5)]  # a side or a shared token is missing
    w = spark.createDataFrame(rows, "country_key string, token string, entity_id string, side int, w double")
    r = B.ranked(B.scored_pairs(w))
    fwd, rev = r.where("fwd < 4").select("s1_id", "cand_id", "fwd"), r.where("rev < 2").select("s1_id", "cand_id", "rev")
    want = {(x["s1_id"], x["cand_id"], x["fwd"], x["rev"]) for x in fwd.join(rev, ["s1_id", "cand_id"], "full").collect()}
    assert {(x["s1_id"], x["cand_id"], x["fwd"], x["rev"]) for x in B.searched(w, 4, 2).collect()} == want
    got = {(x["s1_id"], x["cand_id"], x["fwd_rank"], x["rev_rank"]) for x in B.candidates(w, 4, 2).collect()}
    assert got == {(a, b, 4 if f is None else f, 2 if g is None else g) for a, b, f, g in want}
    assert B.candidates(w.limit(0)).count() == 0


def test_both_searches_stop_early(spark):
    """Each direction keeps the first rows of a group before it sorts what has been shuffled."""
    w = spark.createDataFrame([("x", "t", i, 1 + i % 2, 0.5) for i in range(9)], "country_key string, token string, entity_id long, side int, w double")
    assert B.searched(w)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4


def test_checks_find_each_violation(spark):
    lists = spark.createDataFrame([("1", "a,a,zz"), ("1", ""), ("9", "b"), ("2", "b")], "source1_entity_id string, matched_entity_ids string")
    cands = spark.createDataFrame([("1", "a,zz"), ("2", "b,yy")], "source1_entity_id string, candidate_entity_ids string")
    got = {r["check"]: r["n"] for r in A.violations(lists, cands, spark.createDataFrame([("1",), ("2",), ("3",)], "s1 string"), spark.createDataFrame([("a",), ("b",)], "m string")).collect()}
    assert got == {"entity listed twice": 1, "entity missing": 1, "entity unknown": 1, "match not a candidate": 1, "match twice in a list": 1, "record matched twice": 1, "match unknown": 1, "candidate unknown": 2}


def test_missing_record_fails(spark):
    prepared = R.prepare(spark.createDataFrame([(1, "a", "b", "x", 1, False)], "entity_id long, business_name string, business_address string, country string, side int, is_s3 boolean"))
    bad = spark.createDataFrame([(1, 2)], "s1_id long, cand_id long")
    with pytest.raises(Exception, match="record is missing"):
        X.both_sides(bad, prepared).collect()


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n007\tNA\t"quoted" st\t\n', encoding="utf-8")
    assert [tuple(r) for r in R.read_tsv(spark, str(path)).collect()] == [("007", "NA", '"quoted" st', "")]
    lists = R.match_lists(spark.createDataFrame([(1,), (2,)], "s1 long"), spark.createDataFrame([(1, "b"), (1, "a")], "s1 long, m string"))
    R.write_tsv(lists, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, quote="").fillna("").collect())) == [("1", "a,b"), ("2", "")]
    t = R.truth_pairs(spark.createDataFrame([("1", " a, b,"), ("2", None), ("3", "")], "source1_entity_id string, matched_entity_ids string"))
    assert sorted(map(tuple, t.collect())) == [("1", "a"), ("1", "b")]


def test_parquet_columns_and_pushdown(spark, tmp_path):
    R.write_parquet(spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "country_key string, a int, b int"), str(tmp_path / "p"))
    df = R.read_parquet(spark, str(tmp_path / "p"), ["a"], "x")
    plan = df._jdf.queryExecution().toString()
    assert [tuple(r) for r in df.collect()] == [(1,)] and "EqualTo(country_key,x)" in plan and "struct<country_key:string,a:int>" in plan


def test_range_reaches_the_scan(spark, tmp_path):
    R.write_parquet(spark.createDataFrame([(1, 0.5), (2, 0.95)], "s1 int, prob double"), str(tmp_path / "p"))
    df = R.read_range(spark, str(tmp_path / "p"), "prob", 0.9, ["s1"])
    assert [r["s1"] for r in df.collect()] == [2] and "GreaterThanOrEqual(prob,0.9)" in df._jdf.queryExecution().toString()


def test_threshold_macro_is_that_of_each_threshold(spark):
    rng = random.Random(9)
    p = spark.createDataFrame([(s, 10 * s + k, "one", round(rng.random(), 2)) for s in range(30) for k in range(rng.randint(0, 4))], "s1 long, m long, model string, prob double")
    t = spark.createDataFrame([(s, 10 * s + rng.randint(0, 4)) for s in range(0, 30, 2)], "s1 long, m long")
    e = spark.range(32).select(F.col("id").alias("s1"), F.lit("one").alias("model"))
    values = [0.1, 0.3, 0.5, 0.9]
    got = {r["param"]: r["score"] for r in D.threshold_macro(p, t, e, values, "model").collect()}
    for v in values:
        want = M.entity_table(D.threshold(p, v), t, e.select("s1")).agg(F.round(F.avg("f"), 6)).first()[0]
        assert got[v] == pytest.approx(want)


def test_model_round_trip_and_unknowns(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), None if i % 3 else float(i), float(i % 7 > 3)) for i in range(60)], "a double, b double, label double")
    m = model.train(rows, ["a", "b"])
    model.save(m, ["a", "b"], str(tmp_path / "m"), tau=0.02)
    again, settings = model.load(str(tmp_path / "m"))
    assert settings == {"columns": ["a", "b"], "tau": 0.02}
    assert [r["p"] for r in model.score(again, rows, ["a", "b"], "p").collect()] == [r["p"] for r in model.score(m, rows, ["a", "b"], "p").collect()]


def test_neural_scorer_keeps_rows(spark):
    d = spark.createDataFrame([(i, "x" * (i % 5), "y") for i in range(20)], "k int, text_a string, text_b string")
    got = model.neural_scores(d, lambda: lambda a, b: [len(x) for x in a], batch=3).collect()
    assert all(r["ce"] == r["k"] % 5 for r in got) and len(got) == 20


def test_splits(spark):
    e = spark.range(500).select(F.col("id").alias("s1")).withColumn("fold", A.fold(F.col("s1")))
    p = A.parts(e, 50, 40, F.xxhash64("s1"))
    assert {r["part"]: r["count"] for r in p.groupBy("part").count().collect()} == {"train": 50, "valA": 20, "valB": 20}
    assert p.where("(part = 'train') = (fold = 'val')").count() == 0
    assert A.fresh(e, p, 30, F.xxhash64("s1")).join(p, "s1").count() == 0
