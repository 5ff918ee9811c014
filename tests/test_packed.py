"""The one-pass normaliser equals text.prepare, the packed search equals the one over all pairs, and neither makes token rows."""

import os

import pytest
from pyspark.sql import functions as F

from kindred.functions import normal, text
from kindred.operators import blocking as B
from kindred.operators import packed
from kindred.plans.linkage import document_search
from kindred.sources import records as R
from kindred.sources.session import checkpoint_dir

ODD = [
    None, "", "  ", "A.B.C. d.e. x.y", "12th 001st 0 000 007a 0a 560 001 123 456 789 1234 567 0b9f050", "www.Foo-bar.co.uk http://a.com x.io", "new york nct of delhi val d oise pas de calais west virginia goa ts",
    "Ünï ßtraße Œuvre İstanbul ŁÓDŹ ſ", "Привет мир hello", "hello big wide world Привет “quoted” — dash", "नमस्ते दुनिया 12", "xİy\U0001f600z", "l3et 4pple c0mpany 10a1", "O'Neil & Sons' `tick` pvt ltd the", "° º 5º a&b&&c", "rue du 1er no suite 5-6 opp.", "ΣΑΣ Θψφχ",
]


def test_normaliser_equals_the_expressions(spark):
    rows = [(i * 100 + j, a, b, " FR the " if j % 2 else a) for i, a in enumerate(ODD) for j, b in enumerate(ODD)]
    r = spark.createDataFrame(rows, "entity_id long, business_name string, business_address string, country string")
    a, b = (sorted(map(tuple, m.prepare(r).select("entity_id", *normal.MADE).collect())) for m in (text, normal))
    assert a == b


@pytest.mark.parametrize("retriever", ["uni", "combo", "combo_ph", "name_words", "addr_words"])
def test_packed_search_equals_all_pairs(spark, retriever, monkeypatch):
    rows = []
    for i in range(260):
        name = " ".join(f"{'ab'[i % 2]}{w}ph{(i * w) % 7}" for w in range(1, 4)) + f" {i % 5:03d}"
        rows.append((i * 3 % 260, ["x", "y", ""][i % 3], 1 + (i % 4 > 0), name, name, " ".join(f"w{(i + w * w) % 23} {(i * w) % 11:02d}" for w in range(i % 9))))
    p = spark.createDataFrame(rows, "entity_id long, country_key string, side int, name_n string, name_core string, addr_n string")
    monkeypatch.setattr(packed, "MOST", (9, 13))  # several blocks on both sides
    monkeypatch.setattr(packed, "MATCHES", 50)
    keep = lambda c, k: F.when(F.col(c) < k, F.col(c)).alias(c)
    want = B.ranked(B.scored_pairs(B.weighted(p, retriever, 2, 60))).where("fwd < 4 OR rev < 2").select("s1_id", "cand_id", F.round("score", 9).alias("s"), keep("fwd", 4), keep("rev", 2))
    got = B.searched_records(p, retriever, 2, 60, 4, 2).select("s1_id", "cand_id", F.round("score", 9).alias("s"), "fwd", "rev")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count()


def test_ids_that_repeat_or_are_null_are_searched_as_token_rows(spark):
    rows = [(1, "x", 1, "a b", "a b", "c d"), (2, "x", 2, "a b", "a b", "c d"), (2, "x", 2, "a b", "a b", "c e"), (3, "x", 2, "q", "q", "c e")]
    p = spark.createDataFrame(rows, "entity_id long, country_key string, side int, name_n string, name_core string, addr_n string")
    want = B.searched(B.weighted(p, "uni"))
    assert sorted(map(str, B.searched_records(p, "uni").collect())) == sorted(map(str, want.collect()))


def test_candidates_write_little(spark):
    d = "/root/testdata/sf0.01"
    top = checkpoint_dir(spark).removeprefix("file:")
    size = lambda: {f: os.path.getsize(f) for at, _, names in os.walk(top) for n in names if os.path.exists(f := os.path.join(at, n))}
    before = size()
    found = document_search(spark, d)
    assert found.count() == 5237
    new = sum(n for f, n in size().items() if f not in before)
    assert new <= 4 * os.path.getsize(f"{d}/documents.parquet")
    assert R.prepared_documents(spark, d).count() == 1000


def test_documents_are_prepared_in_one_pass(spark):
    d = "/root/testdata/sf0.001"
    columns = ["entity_id", "side", "is_s3", "country", *normal.MADE]
    a, b = (sorted(map(str, x.select(*columns).collect())) for x in (text.prepare(R.document_records(spark, d)), R.prepared_documents(spark, d)))
    assert a == b
