"""The stage runner: freshness, redo, and the linkage from documents to match lists."""

from __future__ import annotations

import pytest

from kindred.plans import stages as S

from .conftest import SMALL


def test_freshness_and_redo(spark, tmp_path):
    made = []

    def stage(name, reads=(), **p):
        def make(spark, t):
            made.append(name)
            return spark.range(sum(x.count() for x in t.values()) + 1)

        return S.Stage(name, make, reads, p)

    run = lambda stages, redo=None: (made.clear(), S.run(spark, stages, str(tmp_path), redo, lambda _: None))[1]
    one = [stage("a", k=1), stage("b", ("a",)), stage("c")]
    assert run(one)["b"].count() == 2 and made == ["a", "b", "c"]
    run(one)
    assert made == []
    run([stage("a", k=2), *one[1:]])  # a changed parameter reaches what reads it, and nothing else
    assert made == ["a", "b"]
    run([stage("a", k=2), *one[1:]], redo="b")
    assert made == ["b", "c"]
    assert {x.name for x in tmp_path.iterdir()} >= {"a", "a.before", "b.before", "c.before"}  # what a stage made before is set aside

    def fails(spark, t):
        raise ValueError("no")

    with pytest.raises(ValueError):
        run([stage("a", k=2), S.Stage("b", fails, ("a",), {}), stage("c")], redo="b")
    assert made == [] and S.recorded(spark, f"{tmp_path}/b") is None  # nothing after it ran, and it isn't done
    run([stage("a", k=2), *one[1:]])
    assert made == ["b"]
    assert S.all_there(spark, [str(tmp_path)]) and not S.all_there(spark, [str(tmp_path), f"{tmp_path}/no"])


def test_linkage(spark, tmp_path):
    done = S.run(spark, S.linkage_stages(SMALL), str(tmp_path), say=lambda _: None)
    lists = done["matches"]
    assert lists.count() == done["prepared"].where("side = 1").count()
    assert lists.columns == ["source1_entity_id", "matched_entity_ids"]
    report = {(r["part"], r["figure"]): r["value"] for r in done["report"].collect()}
    assert 0 <= report["valB", "macro F0.5"] <= 1 and ("valB", "logloss of prob") in report
