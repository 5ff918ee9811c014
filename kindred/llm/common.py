"""What several operators of this package share: lineage cuts, bounded broadcasts, words, components."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import cut

#: Ids up to this many (8 bytes each, in lists of about LISTED) may be broadcast; above it a shuffle join is used.
BROADCAST_IDS = 500_000
LISTED = 64
#: Rows of text that a Python operator holds as str at one time.
SLICE = 256
#: Longer words (in bytes) are worked on anew each time, so that a cache of n words holds at most about n * (CACHED + 100) bytes.
CACHED = 64
#: A key is hot if it has more than one in HOT of all rows, so there are fewer than HOT hot keys, whatever the size of the table.
HOT = 2000


def integral(df: DataFrame, column: str) -> Column:
    """The column as long; other types than integers are refused at once, as ids are ordered and compared as numbers."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} has type {kind}; this operator needs integer ids (map others to integers first)")
    return F.col(column).cast("long")


def let(value: Column, body) -> Column:
    """body(value), the value computed once: expressions would be copied wherever they are used, and plans grow with that."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stable(df: DataFrame) -> DataFrame:
    """df with partitions that hold the same rows in the same order when a lost task runs again.

    Scans do; what comes out of a shuffle has no fixed order, so it is written to the shared folder and read from there.
    """
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def settle(df: DataFrame) -> DataFrame:
    """df, after the session was told to delete the shuffle files of tables that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after: an iteration's files would add up till then.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows (materialised, it is read twice) joined to counted, a materialised row per key with the number n of rows that have it.

    The hot keys, fewer than HOT, are broadcast and their rows stay where they are; the others are shuffled, and none of
    them has more than one in HOT of the rows. how: inner or left; rows of a null key never match.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(counted.where(F.col(n) * HOT > total))
    warm = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti")
    return warm.unionByName(rest.join(counted.where(F.col(n) * HOT <= total).hint("merge"), key, how))


def only_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key, an integer, is in ids (one column, distinct, materialised); with left_anti the others, and null keys.

    The ids are broadcast only if counted small, and then as lists: a row per id takes the driver several times as much memory.
    """
    n = ids.limit(BROADCAST_IDS + 1).count()
    if n > BROADCAST_IDS:
        return df.join(ids.hint("merge"), key, how)
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(n // LISTED + 1).cast("long"))
    own = F.col(key).cast("long")
    lists = ids.groupBy(place(own).alias("_place")).agg(F.collect_list(own).alias("_ids"))
    return df.join(F.broadcast(lists), (place(own) == F.col("_place")) & F.array_contains("_ids", own), how)


#: Rows (of at most some hundred bytes) that a partition should have at least.
FEWEST = 20_000


def gathered(made: DataFrame) -> DataFrame:
    """made, a materialised table of small rows, in no more partitions than cores or than FEWEST rows each need.

    What comes out of a shuffle has as many partitions as the largest shuffle needs, and each costs every later stage a task.
    """
    needed = -(-made.count() // FEWEST)
    return made.coalesce(max(needed, made.sparkSession.sparkContext.defaultParallelism))


@functools.cache
def _freeze() -> None:
    """Once a process: what the imports made is not searched for garbage at the end of every task, which takes 80 ms."""
    gc.collect()
    gc.freeze()


def lean(run):
    """A function for mapInArrow that gives freed memory back at once, and when it ends; workers are reused and would keep it."""

    @functools.wraps(run)
    def wrapped(batches):
        _freeze()
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            if hasattr(ctypes.CDLL(None), "malloc_trim"):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when it holds `most` words, and long words are not kept, so its memory is bounded."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, split at ASCII white space (what bytes.lower and bytes.split do)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def slices(batches, columns: tuple[str, ...], text: str, chars: int = 2_000_000):
    """Arrow batches -> lists of Python values of the columns, cut before SLICE rows or about `chars` characters."""
    for batch in batches:
        size = batch.column(text).nbytes // max(1, len(batch))
        step = max(1, min(SLICE, chars // max(1, size)))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield [part.column(c).to_pylist() for c in columns]


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        a = (a ^ (a >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return a ^ (a >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams at positions 0..len-n."""
    size = len(words) - n + 1
    if size <= 0:
        return words[:0]
    out = words[:size]
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = mix(out) + words[i : i + size]
    return mix(out + np.uint64(n))


#: Links that one task contracts at a time: some 100 MB of arrays.
CONTRACTED = 500_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: (id, smallest id reachable over these links), without the smallest ids themselves."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        for x in (a, b):
            np.minimum.at(new, low[x], m)
            np.minimum.at(new, x, m)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, low):
            break
        low = new
    some = np.flatnonzero(low != np.arange(len(ids)))
    return ids[some], ids[low[some]]


def _contract(batches):
    """Links (u, v) -> stars, CONTRACTED links at a time."""
    held, n = [], 0

    def stars():
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv")
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in contracted(u, v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CONTRACTED:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected links -> (id, component_id), component_id the smallest id reachable, for every id with a link.

    Tasks first contract the links that they hold to stars, CONTRACTED links at a time. So many in all are done with that;
    more go on by alternate large-star and small-star contractions until nothing changes. Each round is two
    shuffles of the remaining links and is cut, so neither lineage nor driver memory grows.
    """
    sign = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n = e.count()
    if n:
        e = cut(e.coalesce(-(-n // CONTRACTED)).mapInArrow(lean(_contract), "u long, v long"))
    before = sign(e) if n > CONTRACTED else None
    while n > CONTRACTED:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = settle(cut(small.union(low.select("u", F.col("m").alias("v"))).distinct()))
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select("v", "v").distinct())
