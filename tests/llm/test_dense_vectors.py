"""Links within a dense cone that holds a third of the vectors."""

from __future__ import annotations

import numpy as np

from kindred.llm import embedding_links as E


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_links_of_a_dense_cone(spark):
    """Pairs at cosine 0.9 and a hair more; the cone's vectors have a squared cosine of 0.7 to its centre."""
    rng = np.random.default_rng(11)
    n, dim, q, c = 1000, 64, 0.7, 0.9001
    centre = unit(rng.standard_normal(dim))
    across = lambda u: unit(u - np.outer(u @ centre, centre))
    u = across(rng.standard_normal((n, dim)))
    w = across(rng.standard_normal((n, dim)))
    w = unit(w - (w * u).sum(1, keepdims=True) * u)
    t = (c - q) / (1 - q)
    x = np.sqrt(q) * centre + np.sqrt(1 - q) * u
    y = np.sqrt(q) * centre + np.sqrt(1 - q) * (t * u + np.sqrt(1 - t * t) * w)
    v = np.concatenate([x, y, unit(rng.standard_normal((4 * n, dim)))])
    want = (v @ v.T >= 0.9).sum() - len(v)
    assert want >= 2 * n
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(v)]
    found = sum(r["n_links"] for r in E.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert 0.985 * want <= found <= want


def test_more_pivots_describe_a_vector_where_there_are_more():
    assert [E.described_by(m) for m in (1, 9, 512, 1024, 2048, 4096)] == [1, 9, 10, 12, 14, 16]
