"""TF-IDF token blocking: weights (T7-T11), the top-k similarity join (J1-J4), group statistics (A1), recall.

Countries are a key column, never a loop. The upper limit on a token's document frequency bounds the join's fan-out.
`searched` is the sparse top-k product that Spark lacks: each country's sides are cut into blocks, every pair of blocks is
scored where it meets, and only what can be among the first k of a record leaves it. Pairs that share a token are many
times more than records, and none of them is ever shuffled. `scored_pairs` and `ranked` are the same as one join and one
aggregation, for when all pairs are wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import RETRIEVERS
from ..sources.session import cut
from .packed import chunks, cosines, forget, found_in, ids_are_keys

K_FORWARD, K_REVERSE = 20, 3
SCORE_FLOOR = 1e-9
#: Records in a block of side 1 and of side 2: at least, and at most; between, a country has PARTS blocks a side.
LEAST_BLOCK, MOST_BLOCK, PARTS = (250, 1000), (20_000, 50_000), 8
#: Token matches that are multiplied at a time.
MATCHES = 4_000_000


def tokens(prepared: DataFrame, retriever: str = "combo_ph") -> DataFrame:
    """(country_key, token, entity_id, side): a row per distinct token of a record."""
    make = RETRIEVERS[retriever](F.col("name_n"), F.col("name_core"), F.col("addr_n"))
    return prepared.select("country_key", "entity_id", "side", F.explode(make).alias("token"))


def weights(rows: DataFrame, least_df: int = 2, max_df: int | None = 5000) -> DataFrame:
    """Rows with w, the L2-normalised smoothed inverse document frequency; tokens outside the df gate go.

    Documents of a block are all records that have tokens or not, so the count comes from block sizes in `n`.
    """
    df = rows.groupBy("country_key", "token").agg(F.count("*").alias("df"))
    df = df.where(F.col("df") >= least_df) if max_df is None else df.where(F.col("df").between(least_df, max_df))
    kept = rows.join(df, ["country_key", "token"])
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    kept = kept.withColumn("idf", idf)
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(W.partitionBy("entity_id")))
    return kept.withColumn("w", F.col("idf") / norm)


def with_block_sizes(rows: DataFrame, prepared: DataFrame) -> DataFrame:
    """Adds n, the records of the country on both sides; a row per country, broadcast by the planner where it is small."""
    return rows.join(prepared.groupBy("country_key").agg(F.count("*").alias("n")), "country_key")


def weighted(prepared: DataFrame, retriever: str = "combo_ph", least_df: int = 2, max_df: int | None = 5000) -> DataFrame:
    """T11. Tokens and weights are used several times, so each is computed once and cut."""
    rows = cut(tokens(prepared, retriever))
    return cut(weights(with_block_sizes(rows, prepared), least_df, max_df))


def scored_pairs(weighted_rows: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score) of all pairs across the sides that share a token; one equi-join and one aggregation."""
    a = weighted_rows.where("side = 1").select("country_key", "token", F.col("entity_id").alias("s1_id"), F.col("w").alias("wa"))
    b = weighted_rows.where("side = 2").select("country_key", "token", F.col("entity_id").alias("cand_id"), F.col("w").alias("wb"))
    pairs = a.join(b, ["country_key", "token"]).groupBy("country_key", "s1_id", "cand_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    return pairs.where(F.col("score") > SCORE_FLOOR)


def ranked(scores: DataFrame) -> DataFrame:
    """Forward and reverse ranks from 0; ties by id, on scores rounded to six places."""
    order = F.round("score", 6).desc()
    forward = F.row_number().over(W.partitionBy("s1_id").orderBy(order, "cand_id")) - 1
    reverse = F.row_number().over(W.partitionBy("cand_id").orderBy(order, "s1_id")) - 1
    return scores.withColumn("fwd", forward).withColumn("rev", reverse)


def packed(weighted_rows: DataFrame) -> DataFrame:
    """A row per record: country_key, side, entity_id, tokens (64-bit hashes) and their weights."""
    items = F.collect_list(F.struct(F.xxhash64("token").alias("t"), "w"))
    return weighted_rows.groupBy("country_key", "side", "entity_id").agg(items.alias("i")).select("country_key", "side", "entity_id", F.col("i.t").alias("t"), F.col("i.w").alias("w"))


def _first(by: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Of an order (by) in which groups are contiguous, the places among the first k of their group."""
    g = group[by]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return by[rank < k]


def _score_block(k_forward: int, k_reverse: int):
    """A function of two blocks of records: their pairs that are among the first k of a record within them, and in which search."""

    def side(block: pa.Table, names: tuple[str, str, str]):
        block = block.take(np.argsort(block.column(names[0]).to_numpy(), kind="stable"))  # the lower id wins ties, so records go by id
        ids, t, w = (block.column(c).combine_chunks() for c in names)
        return ids, np.diff(t.offsets.to_numpy()), t.flatten().to_numpy(), w.flatten().to_numpy()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids_a, size_a, ta, wa = side(left, ("entity_id", "t", "w"))
            ids_b, size_b, tb, wb = side(right, ("id_b", "t_b", "w_b"))
            by = np.argsort(tb, kind="stable")
            tb, wb, record_b = tb[by], wb[by], np.repeat(np.arange(len(ids_b)), size_b)[by]
            record_a, ends = np.repeat(np.arange(len(ids_a)), size_a), np.cumsum(size_a)
            first = np.searchsorted(tb, ta, "left")
            n = np.searchsorted(tb, ta, "right") - first
            total = np.r_[0, np.cumsum(np.bincount(record_a, n, len(ids_a)).astype(np.int64))]
            at = 0
            while at < len(ids_a):
                to = max(at + 1, int(np.searchsorted(total, total[at] + MATCHES, "right")) - 1)
                e = slice(ends[at - 1] if at else 0, ends[to - 1])
                c = n[e]
                x = np.repeat(first[e] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                pair, which = np.unique(np.repeat(record_a[e], c) * len(ids_b) + record_b[x], return_inverse=True)
                score = np.bincount(which, np.repeat(wa[e], c) * wb[x], len(pair)).astype(np.float64)
                pair, score = pair[score > SCORE_FLOOR], score[score > SCORE_FLOOR]
                a, b, q = pair // len(ids_b), pair % len(ids_b), -np.floor(score * 1e6 + 0.5)
                fwd, rev = np.zeros(len(pair), dtype=bool), np.zeros(len(pair), dtype=bool)
                fwd[_first(np.lexsort((b, q, a)), a, k_forward)] = True
                rev[_first(np.lexsort((a, q, b)), b, k_reverse)] = True
                some = fwd | rev
                found.append((a[some], b[some], score[some], fwd[some], rev[some]))
                at = to
        if not found:
            return pa.table({"country_key": pa.array([], pa.string()), "s1_id": left.column("entity_id").slice(0, 0), "cand_id": right.column("id_b").slice(0, 0), "score": pa.array([], pa.float64()), "f": pa.array([], pa.bool_()), "r": pa.array([], pa.bool_())})
        a, b, score, fwd, rev = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"country_key": pa.array([key[0].as_py()] * len(a), pa.string()), "s1_id": ids_a.take(pa.array(a)), "cand_id": ids_b.take(pa.array(b)), "score": score, "f": fwd, "r": rev})

    return run


def searched(weighted_rows: DataFrame, k_forward: int = K_FORWARD, k_reverse: int = K_REVERSE) -> DataFrame:
    """(country_key, s1_id, cand_id, score, fwd, rev): pairs among the first k of either search, ranks from 0, null beyond k.

    Equal to ranked(scored_pairs(...)) with ranks cut off. A hot country is many blocks; a hot token is bounded by the gate.
    """
    records = cut(packed(weighted_rows))
    n = records.groupBy("country_key").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2")).where("n1 > 0 AND n2 > 0")
    parts = lambda n, s: F.greatest(F.ceil(n / MOST_BLOCK[s]), F.least(F.lit(PARTS), F.ceil(n / LEAST_BLOCK[s]))).cast("int")
    blocks = n.select("country_key", parts(F.col("n1"), 0).alias("p1"), parts(F.col("n2"), 1).alias("p2"))  # a row per country
    own = lambda p: F.pmod(F.xxhash64("entity_id"), p).cast("int")
    every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    placed = records.join(blocks, "country_key")
    a = placed.where("side = 1").select("country_key", own(F.col("p1")).alias("i"), every("p2").alias("j"), "entity_id", "t", "w")
    again = {"country_key": "country_b", "entity_id": "id_b", "t": "t_b", "w": "w_b"}  # names that the plan can tell from those of a
    b = placed.where("side = 2").select(every("p1").alias("i_b"), own(F.col("p2")).alias("j_b"), *[F.col(c).alias(n) for c, n in again.items()])
    kind = dict(weighted_rows.dtypes)["entity_id"]
    found = a.groupBy("country_key", "i", "j").cogroup(b.groupBy("country_b", "i_b", "j_b")).applyInArrow(_score_block(k_forward, k_reverse), f"country_key string, s1_id {kind}, cand_id {kind}, score double, f boolean, r boolean")
    return first_ranks(cut(found), k_forward, k_reverse)


def first_ranks(found: DataFrame, k_forward: int, k_reverse: int) -> DataFrame:
    """Ranks of pairs that are among the first of a record within blocks, in the forward search (f) or the reverse one (r)."""
    pair = ["country_key", "s1_id", "cand_id"]

    def best(search: str, own: str, other: str, k: int, out: str) -> DataFrame:
        order = W.partitionBy(own).orderBy(F.round("score", 6).desc(), other)
        kept = found.where(search).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
        return kept.select(*pair, F.col("score").alias(f"{out}_score"), (F.col("_k") - 1).alias(out))

    both = best("f", "s1_id", "cand_id", k_forward, "fwd").join(best("r", "cand_id", "s1_id", k_reverse, "rev"), pair, "full")
    return both.select(*pair, F.coalesce("fwd_score", "rev_score").alias("score"), "fwd", "rev")


def searched_records(prepared: DataFrame, retriever: str = "combo_ph", least_df: int = 2, max_df: int | None = 5000, k_forward: int = K_FORWARD, k_reverse: int = K_REVERSE, held: DataFrame | None = None) -> DataFrame:
    """searched(weighted(prepared, ...)) without a row per token (see packed); ids that repeat or are null take that way itself.

    held: the packed records, chunks(prepared), if they are there already.
    """
    held = held or cut(chunks(prepared))
    if not ids_are_keys(held, dict(prepared.dtypes)["entity_id"]):
        return searched(weighted(prepared, retriever, least_df, max_df), k_forward, k_reverse)
    return first_ranks(found_in(held, dict(prepared.dtypes)["entity_id"], retriever, least_df, max_df, k_forward, k_reverse), k_forward, k_reverse)


def clipped(found: DataFrame, k_forward: int = K_FORWARD, k_reverse: int = K_REVERSE) -> DataFrame:
    """A rank that is not among the first k is k."""
    rank = lambda c, k: F.coalesce(F.col(c), F.lit(k)).cast("short")
    return found.select("country_key", "s1_id", "cand_id", "score", rank("fwd", k_forward).alias("fwd_rank"), rank("rev", k_reverse).alias("rev_rank"))


def candidates(weighted_rows: DataFrame, k_forward: int = K_FORWARD, k_reverse: int = K_REVERSE) -> DataFrame:
    """Pairs among the first of either search; a rank beyond its depth is the depth."""
    return clipped(searched(weighted_rows, k_forward, k_reverse), k_forward, k_reverse)


def group_stats(pairs: DataFrame) -> DataFrame:
    """A1: best score and number of pairs, of each pair's record on either side."""
    a, b = W.partitionBy("s1_id"), W.partitionBy("cand_id")
    return pairs.withColumns({"s1_max": F.max("score").over(a), "s1_n": F.count("*").over(a), "cand_max": F.max("score").over(b), "cand_n": F.count("*").over(b)})


def pair_cosine(pairs: DataFrame, weighted_rows: DataFrame, out: str) -> DataFrame:
    """J4 for given pairs: adds the cosine over the weighted tokens, 0 where none is shared."""
    a = weighted_rows.where("side = 1").select(F.col("entity_id").alias("s1_id"), "token", F.col("w").alias("wa"))
    b = weighted_rows.where("side = 2").select(F.col("entity_id").alias("cand_id"), "token", F.col("w").alias("wb"))
    keys = pairs.select("s1_id", "cand_id").distinct()
    dots = keys.join(a, "s1_id").join(b, ["cand_id", "token"]).groupBy("s1_id", "cand_id").agg(F.sum(F.col("wa") * F.col("wb")).alias(out))
    return pairs.join(dots, ["s1_id", "cand_id"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def pair_cosines(pairs: DataFrame, prepared: DataFrame, retrievers: dict[str, str], least_df: int = 2, max_df: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """pair_cosine over weighted(prepared, ...) of each retriever, by the name of its column, without a row per token (see packed).

    Ids that repeat or are null, and pairs across countries, take the way of token rows. held as in searched_records.
    """
    held, kind = held or cut(chunks(prepared)), dict(prepared.dtypes)["entity_id"]
    forget(pairs.sparkSession)
    found = cosines(held, kind, pairs, retrievers, least_df, max_df) if ids_are_keys(held, kind) else None
    if found is not None:
        return pairs.join(found, ["s1_id", "cand_id"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in retrievers})
    for out, retriever in retrievers.items():
        pairs = pair_cosine(pairs, weighted(prepared, retriever, least_df, max_df), out)
    return pairs


def recall_at(truth: DataFrame, ranks: DataFrame, depths: tuple[int, ...] = (5, 10, 20, 30, 50, 100), reverse: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of true pairs found at each depth, forward, reverse and in union of forward k and reverse 3."""
    t = truth.join(ranks.select(F.col("s1_id").alias("s1"), F.col("cand_id").alias("m"), "fwd", "rev"), ["s1", "m"], "left")
    hit = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    rows = [("forward", k, hit(F.col("fwd") < k)) for k in depths] + [("reverse", k, hit(F.col("rev") < k)) for k in reverse]
    rows += [("union", k, hit((F.col("fwd") < k) | (F.col("rev") < K_REVERSE))) for k in depths]
    one = t.agg(F.array(*[F.struct(F.lit(n).alias("search"), F.lit(k).alias("k"), F.round(e, 6).alias("recall")) for n, k, e in rows]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")
