"""Embedding near-duplicates by a pivot-permutation index (operator 7).

Reference points (pivots) are a sample of the vectors, as many as the root of their number, so that lists and pivots grow
alike. Every vector is described by its nearest pivots, more of them where there are more pivots, nearest first in the
permutation; inverted lists hold, for each pivot, the vectors
that have it. All pairs within a list are candidates and verified by cosine in double precision. A pair counts in the
list of its smallest common pivot only. Long lists are worked on in pairs of blocks, so that no task holds more than
two blocks, and none of the pairs leaves its task: what comes out are link counts per vector and links that span the
components.

A pair is missed if it shares none of its nearest pivots; the README has recall by the number of pivots.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, integral, lean
from .near_duplicates import grouped

#: Pivots at least (above it, the root of the number of vectors), pivots that describe a vector at least, and how many more for each doubling of the pivots.
PIVOTS, NEAREST, MORE = 512, 10, 2
#: Pivots have cosines below this to one another.
APART = 0.8
#: Vectors in a block of a list; candidate pairs verified at a time.
BLOCK, PAIRS = 1024, 100_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled first, so that large and tiny components neither overflow nor vanish."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """The first vectors of a sample that are not close to one another: a large group of near copies gives one pivot, not many.

    With many pivots inside a group, its vectors would have their nearest ones by chance and share too few.
    """
    kept = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), BLOCK):  # never all pairs at once
        block = sample[at : at + BLOCK]
        block = block[~(block @ kept.T >= APART).any(axis=1)]
        near = block @ block.T >= APART
        own: list[int] = []
        for i in range(len(block)):
            if not near[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, block[own]])
        if len(kept) >= most:
            break
    return kept[:most]


def described_by(pivots: int) -> int:
    """How many pivots describe a vector: pivots that lie closer together are shared by fewer pairs, so it takes more."""
    return min(pivots, NEAREST + MORE * max(0, (max(1, pivots) - 1) // PIVOTS).bit_length())


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _described(classes: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    k = described_by(len(pivots))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                near = unit(_vectors(part.column("v"), dim)) @ pivots.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), part.column("v"), lists], names=["rep", "n", "v", "pivots"])

    return classes.select("rep", "n", "v").mapInArrow(lean(run), f"rep long, n long, v {dict(classes.dtypes)['v']}, pivots array<int>")


def _search(dim: int, least: float):
    """Sorted rows (list, pivot, block, other, rep, n, v, pivots) -> (a, b, n): b null: n vectors linked to a; n null: a and b are linked."""

    def near(x, y, sx, sy, p, same):
        """Index pairs that pass the cosine and have p as the smallest pivot they share."""
        ok = x @ y.T >= least - 1e-9  # what rounds differently is decided below
        if same:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), PAIRS // 4):
            s = slice(at, at + PAIRS // 4)
            a, b = sx[i[s]], sy[j[s]]
            shared = np.zeros(len(a), dtype=bool)
            for k in range(a.shape[1]):
                shared |= ((a[:, k, None] == b) & (b < p)).any(axis=1)
            keep[s] = ~shared & (np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= least)
        return i[keep], j[keep]

    def run(batches):
        for table in grouped(batches, "list"):
            key, block = table.column("list").to_numpy(), table.column("block").to_numpy()
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                own, p = block[a:b], part.column("pivot")[0].as_py()
                low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
                x = unit(_vectors(part.column("v").combine_chunks(), dim))
                sets = part.column("pivots").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
                first = np.flatnonzero(own == low)
                second = first if low == high else np.flatnonzero(own == high)
                if not len(first) or not len(second):
                    continue
                i, j = near(x[first], x[second], sets[first], sets[second], p, low == high)
                if not len(i):
                    continue
                i, j = first[i], second[j]
                rep, n = part.column("rep").to_numpy(), part.column("n").to_numpy()
                links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
                root = np.arange(len(x))
                while True:  # smallest row reachable over the links
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    np.minimum.at(new, j, root[i])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                some, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[rep[some], rep[joined]], pa.int64()),
                        pa.array([None] * len(some) + rep[root[joined]].tolist(), pa.int64()),
                        pa.array(links[some].astype(np.int64).tolist() + [None] * len(joined), pa.int64()),
                    ],
                    names=["a", "b", "n"],
                )

    return run


def _links(classes: DataFrame, dim: int, least: float) -> DataFrame:
    count = classes.count()
    m = max(PIVOTS, isqrt(count))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(2 * m).select("v").toArrow()  # twice the root of the number of vectors
    pivots = spread(unit(_vectors(sample["v"].combine_chunks(), dim)), m)
    rows = cut(_described(classes, pivots, dim))
    lists = rows.select("*", F.explode("pivots").alias("pivot"))
    sizes = F.broadcast(lists.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # a row per pivot
    lists = lists.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    lists = lists.select(F.xxhash64("pivot", "low", "high").alias("list"), "pivot", "low", "high", "block", "rep", "n", "v", "pivots")
    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(lean(_search(dim, least)), "a long, b long, n long")


def embedding_links(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, n_links, component_id (smallest key reachable over links), kept (key = component_id), for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows of a null key link with nothing, have a null component and are kept; rows that repeat a key
    and a vector count as one. Of several vectors of a key one, that of the least hash, is linked; its other rows get the
    result of that vector's copies, if it has any, else no links. Keys are integers, other types are refused; other columns are not read, so their names can't clash; an empty table gives none. Copies of a vector
    become one class first, so their number costs nothing.
    """
    e = F.col(embedding)
    ok = F.coalesce(e.isNotNull() & F.col(key).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    drawn = vectors.select(integral(vectors, key).alias("_id"), F.when(ok, e).alias("v"))
    drawn = drawn.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v")).otherwise(F.xxhash64("_id"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("v"), "v")))
    good = drawn.where("v IS NOT NULL").groupBy("_id").agg(F.min("h1").alias("h1"), F.min_by("h2", "h1").alias("h2"), F.min_by("v", "h1").alias("v"))
    classes = cut(good.groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    found = None
    for (dim,) in classes.select(F.size("v")).distinct().collect():  # lengths of vectors, one as a rule
        made = _links(classes.where(F.size("v") == dim), dim, least)
        found = made if found is None else found.union(made)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "a long, b long, n long")
    found = cut(found)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    components = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("h1", "h2", "rep", "n").join(counts, F.col("rep") == F.col("a"), "left").join(components, F.col("rep") == F.col("id"), "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = drawn.select("_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias(key), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def oracle(least: float = 0.9) -> str:
    """DuckDB SQL for embedding_links(embeddings), by brute force."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.e IS NOT NULL AND b.e IS NOT NULL AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {least}),
walk(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.vec_id, links.b FROM walk JOIN links ON walk.other = links.a),
reach AS (SELECT vec_id, min(other) AS component_id FROM walk GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN reach USING (vec_id) LEFT JOIN counts USING (vec_id)"""
