"""The cascade and the stage runner train on the string metrics too, and a query gives them over the candidates."""

from __future__ import annotations

from kindred.functions import similarity as S
from kindred.operators import model
from kindred.plans import registry, stages
from kindred.sources import records as R

from .conftest import SMALL

registry.load()


def test_string_metrics_reach_the_models(spark, monkeypatch):
    seen = []
    out = "s1_id", "cand_id", "'enc' AS part", "0.5D AS p1", "'match' AS p1_by", "0.5D AS prob", "'match' AS prob_by"
    monkeypatch.setattr(model, "cascade", lambda features, *_: (seen.append(set(features.columns)), (features.selectExpr(*out), {}))[1])
    registry.QUERIES["model_cascade"](spark, SMALL)
    s = {x.name: x for x in stages.linkage_stages(SMALL)}
    prepared = s["prepared"].make(spark, {})
    pairs = spark.createDataFrame([("en", 1, 2, 0.5, 0, 0)], "country_key string, s1_id long, cand_id long, score double, fwd_rank short, rev_rank short")
    seen.append(set(s["features"].make(spark, {"prepared": prepared, "candidates": pairs}).columns))
    assert len(seen) == 2 and all(set(S.NAMES) <= x for x in seen)


def test_string_metrics_of_candidates(spark):
    rows = registry.QUERIES["feat_strings"](spark, SMALL).limit(5).collect()
    p = {r["entity_id"]: r for r in R.prepared_documents(spark, SMALL).collect()}
    assert rows
    for r in rows:
        a, b = p[r["s1_id"]], p[r["cand_id"]]
        assert r["name_ratio"] == round(S.ratio(a["name_n"], b["name_n"]), 4)
        assert r["addr_tset"] == round(S.token_set(a["addr_n"], b["addr_n"]), 4)
        assert abs(r["addr_partial"] - S.partial(a["addr_n"], b["addr_n"])) < 1e-4
