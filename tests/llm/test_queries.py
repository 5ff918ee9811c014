"""The package's queries against their SQL, and the pipeline against the operators it is made of."""

from __future__ import annotations

import pytest

from kindred.llm import queries

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, compare):
    compare(queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline(spark):
    """Each stage by its operator's own result on the stage's input."""
    import hashlib

    import corpus_pipeline as P
    from kindred.llm import byte_bpe, decontamination, near_duplicates, quality

    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda x: {r["doc_id"] for r in x.select("doc_id").collect()}
    good = P.quality_stage(spark, d, SMALL)
    assert good.columns == d.columns and ids(good) == ids(quality.classify(d).where("kept"))
    unique = P.near_duplicate_stage(spark, good, SMALL)
    assert unique.columns == d.columns and ids(unique) == ids(near_duplicates.near_duplicates(good).where("kept"))
    clean = P.decontamination_stage(spark, unique, SMALL)
    leaks = ids(decontamination.find_leaks(unique, spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    assert clean.columns == d.columns and ids(clean) == ids(unique) - leaks
    private = P.pii_stage(spark, clean, SMALL)
    assert private.columns == d.columns and ids(private) == ids(clean) and private.where("n_chars <> length(text)").count() == 0
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    last = P.bpe_stage(spark, private, SMALL).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert sorted(map(tuple, P.run(spark, SMALL).collect())) == sorted(map(tuple, last))
    assert byte_bpe.TYPES["ids"]


def hard_rows(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    good = "The council met in the town hall and spoke of the new bridge over the river. It will be built in the spring, and the work is to last for a year. "
    more = "A reader of the paper wrote that the old road is too narrow for the buses. The mayor said that it would be made wider as soon as there is money for it. "
    rows = [(i, good + more + f"This is letter number {i} of the month, sent to the paper by a reader. ", "en", "src0", 1) for i in range(30)]
    rows += [(50, good * 3 + "My address is x@y.org. ", "en", None, None), (51, good * 3 + "My address is x@y.org. ", None, "src1", 5), (50, good * 3 + "My address is x@y.org. ", "en", None, None)]
    rows += [(60, None, "en", "src0", None), (61, "", None, None, 0), (62, " \n\t", "en", "src0", 3), (None, more * 4, "en", "src0", 9), (None, None, None, None, None)]
    long = "".join(f"In part {i} of the long report it is said that the work goes on and the water of the river is high. " for i in range(8000))
    rows += [(70, long, "en", "src2", 7), (71, more + "w" * 300_000 + " " + good, "en", "src2", 8), (72, "!!! $$$ ### " * 50, "en", "src2", 9), (73, "x@" + "a." * 20_000 + "com " + more * 2, "en", "s", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    d = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names))
    extra = ["_text", "_id", "score", "kept", "component_id", "rep", "node", "start", "item_id", "print"]
    return d.selectExpr(*names, *[f"concat('x', doc_id) AS {c}" for c in extra])


def test_stages_on_hard_rows(spark):
    import corpus_pipeline as P

    docs = hard_rows(spark)
    at = docs
    for name, stage in P.STAGES:
        out = stage(spark, at, SMALL)
        rows = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
            # a row's other columns stay with it
            assert all(r[c] == (None if r["doc_id"] is None else f"x{r['doc_id']}") for r in rows for c in ("_text", "score", "print"))
        ids = [r["doc_id"] for r in rows]
        assert not {60, 61, 62, 72} & set(ids) and 70 in ids
        if name == "quality":
            assert ids.count(50) == 2 and 71 in ids and None in ids
        if name == "near_duplicates":
            assert ids.count(50) == 2 and 51 not in ids and ids.count(None) == 1
        if name == "pii":
            assert not any("x@y.org" in r["text"] for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        at = spark.createDataFrame(rows, out.schema)
    assert len(rows) == len(ids)


@pytest.mark.parametrize("kind", ["empty", "one row"])
def test_stages_on_little(spark, kind):
    import corpus_pipeline as P

    docs = hard_rows(spark).where("false" if kind == "empty" else "doc_id = 0")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMALL).count() <= docs.count()


def test_nothing_to_decontaminate_against(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = hard_rows(spark)
    assert P.decontamination_stage(spark, docs, str(tmp_path)).count() == docs.count()
