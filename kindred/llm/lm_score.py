"""Stupid-backoff scores of documents under the corpus without themselves (operator 3).

The n-grams of every document are exploded and counted over the whole corpus in tables partitioned by n-gram hash; the
counts are joined back to the documents' n-grams and summed per document. A document's own occurrences are taken off
all counts, else every n-gram would be known and nothing would ever back off.

The exploded table (chunk, n, key, count) is kept in packed rows: a chunk of documents has, for each order and range of
hashes, one row with the sorted distinct hashes of its n-grams and their counts in the chunk. Three steps follow.

1. explode: documents -> packed n-grams, already summed within a chunk, so a frequent n-gram is one entry a chunk
2. count and join, by range of hashes: the counts of all chunks are summed by n-gram, and each chunk's n-grams get the
   sum less their own count
3. score: the counts are co-grouped with the words of their chunk, which are read a second time and come as small
   integers; the words look their n-grams up, back off and are summed by document

A packed row has at least one n-gram, so there are never more rows than a plain table of n-grams would have; packing
only makes them fewer and, by gaps between sorted hashes, smaller.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, integral, lean, mix, ngram_hashes, slices, stable, word_hashes
from .near_duplicates import grouped

#: Longest n-gram, factor of each step back.
ORDER, BACKOFF = 3, 0.4
#: Words after which a chunk is closed (a longer document is a chunk of its own), bytes of text for each range of hashes.
CHUNK, PARTITION_BYTES = 2_500_000, 16 << 20
#: Chunks that a task may have.
CHUNKS = 1 << 24
ROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ROW_SQL = "part int, chunk long, n int, keys binary, counts binary"
WORDS = pa.schema([("chunk", pa.int64()), ("documents", pa.binary()), ("vocabulary", pa.binary()), ("words", pa.binary())])
WORDS_SQL = "chunk long, documents binary, vocabulary binary, words binary"


def _keys(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within one document, and the position of the last word of each; doc is the document of each word."""
    if n == 1:
        return mix(words + np.uint64(1)), np.arange(len(words), dtype=np.int32)
    inside = doc[n - 1 :] == doc[: max(0, len(words) - n + 1)]
    return ngram_hashes(words, n)[inside], np.flatnonzero(inside).astype(np.int32) + np.int32(n - 1)


def _pack(a: np.ndarray) -> bytes:
    """Non-negative integers by byte plane, no more planes than the largest has bytes."""
    width = (int(a.max(initial=0)).bit_length() + 7) // 8
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), dtype=np.uint8)
    out[:, : b[0]] = np.frombuffer(zlib.decompress(b[1:]), dtype=np.uint8).reshape(b[0], size).T
    return out.view("<u8").ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: gaps by byte plane, of which only the upper three, nearly all zero, are compressed."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + planes[:5].tobytes() + zlib.compress(planes[5:].tobytes(), 1)


def _unpack_keys(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.concatenate([np.frombuffer(b, np.uint8, 5 * n, 8).reshape(5, n), np.frombuffer(zlib.decompress(b[8 + 5 * n :]), np.uint8).reshape(3, n)])
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _batches(rows, schema: pa.Schema, size: int = 4 << 20):
    """Tuples -> record batches of about `size` bytes."""
    held, bytes_ = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        bytes_ += sum(len(x) for x in row if isinstance(x, bytes))
        if bytes_ >= size:
            yield made()
            held, bytes_ = [], 0
    if held:
        yield made()


def _chunks(batches):
    """Documents -> (chunk, ids, words of each). A chunk is named by the task's partition and its number there, so equal chunks stay apart."""
    cache = WordHashes()
    chunk = TaskContext.get().partitionId() * CHUNKS
    ids, words, held = [], [], 0
    for some, texts in slices(batches, ("_id", "_text"), "_text", 1_000_000):
        for i, t in zip(some, texts, strict=True):
            w = word_hashes(t, cache)
            if held and held + len(w) > CHUNK:
                yield chunk, ids, words
                chunk += 1
                ids, words, held = [], [], 0
            ids.append(i)
            words.append(w)
            held += len(w)
    if ids:
        yield chunk, ids, words


def _flat(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents in a row, the document of each, and the number of words of each document."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *words]), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), sizes


def _explode(order: int, bits: int):
    """Step 1. Documents -> for each chunk, order and range of hashes its n-grams."""

    def rows(batches):
        for chunk, _, words in _chunks(batches):
            flat, doc, _ = _flat(words)
            for n in range(1, order + 1):
                keys, counts = np.unique(_keys(flat, doc, n)[0], return_counts=True)
                part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    yield int(part[a]), chunk, n, _pack_keys(keys[a:b]), _pack(counts[a:b])

    return lambda batches: _batches(rows(batches), ROW)


def _words(batches):
    """Documents -> each chunk's words: the vocabulary, frequent words first, and the number of each word in it."""

    def rows():
        for chunk, ids, words in _chunks(batches):
            flat, _, sizes = _flat(words)
            vocabulary, at, n = np.unique(flat, return_inverse=True, return_counts=True)
            by_frequency = np.argsort(-n, kind="stable")
            rank = np.empty(len(n), dtype=np.uint32)
            rank[by_frequency] = np.arange(len(n), dtype=np.uint32)
            head = pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes)], names=["id", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            yield chunk, zlib.compress(sink.getvalue().to_pybytes(), 1), vocabulary[by_frequency].tobytes(), _pack(rank[at])

    return _batches(rows(), WORDS)


def _count_and_join(batches):
    """Step 2. Rows of one range of hashes, by order -> for each chunk, the counts of its n-grams in all other chunks (0: none)."""

    def rows():
        for table in grouped(batches, "n"):
            order = table.column("n").to_numpy()
            bounds = np.flatnonzero(np.r_[True, order[1:] != order[:-1], True])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                asked = table.slice(a, b - a).to_pylist()
                own = [_unpack_keys(r["keys"]) for r in asked]
                counts = [_unpack(r["counts"], len(k)) for r, k in zip(asked, own, strict=True)]
                keys, at = np.unique(np.concatenate(own), return_inverse=True)
                total = np.zeros(len(keys), dtype=np.int64)
                np.add.at(total, at, np.concatenate(counts))
                done = 0
                for r, c in zip(asked, counts, strict=True):
                    rest = total[at[done : done + len(c)]] - c
                    done += len(c)
                    yield r["part"], r["chunk"], r["n"], None, len(c).to_bytes(8, "little") + _pack(rest)

    return _batches(rows(), ROW)


def _score(order: int, names: list[str]):
    """Step 3. A chunk's words and the counts of its n-grams -> per document: words, n-grams known in full, log score without the corpus size, words that need it."""

    def elsewhere(rows, flat, doc, n):
        """Occurrences in other documents of the n-gram that ends at each word."""
        rest = np.concatenate([np.zeros(0, np.int64), *[_unpack(r["counts"][8:], int.from_bytes(r["counts"][:8], "little")) for r in rows if r["n"] == n]])
        out = np.zeros(len(flat), dtype=np.int64)
        keys, end = _keys(flat, doc, n)
        if not len(keys):
            return out
        by = np.argsort(keys, kind="stable")  # by n-gram, and for each by document
        keys, end = keys[by], end[by]
        own = doc[end]
        new = keys[1:] != keys[:-1]
        which = np.cumsum(np.r_[False, new])
        pair = np.cumsum(np.r_[False, new | (own[1:] != own[:-1])])
        if len(rest) != which[-1] + 1:
            raise RuntimeError("a chunk and its counts don't belong together; were the documents read in another order?")
        out[end] = (rest + np.bincount(which))[which] - np.bincount(pair)[pair]
        return out

    def score(counts: pa.Table, chunk: pa.Table) -> pa.Table:
        (own,) = chunk.to_pylist()
        rows = counts.select(["part", "n", "counts"]).to_pylist()
        rows.sort(key=lambda r: (r["n"], r["part"]))
        head = pa.ipc.open_stream(zlib.decompress(own["documents"])).read_all()
        ids, sizes = head.column("id"), head.column("n").to_numpy()
        flat = np.frombuffer(own["vocabulary"], dtype=np.uint64)[_unpack(own["words"], int(sizes.sum()))]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        total, penalty = np.zeros(len(flat)), np.zeros(len(flat))
        open_, whole = np.ones(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
        first = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # words before, in the document
        longer = elsewhere(rows, flat, doc, order)
        for n in range(order, 1, -1):
            shorter = elsewhere(rows, flat, doc, n - 1)
            fits = open_ & (first >= n - 1)
            good = np.flatnonzero(fits & (longer > 0))
            total[good] = penalty[good] + np.log(longer[good]) - np.log(shorter[good - 1])
            open_[good] = False
            if n == order:
                whole[good] = True
            penalty[open_ & (first >= n - 1)] += np.log(BACKOFF)
            longer = shorter
        last = np.flatnonzero(open_)
        total[last] = penalty[last] + np.log(np.maximum(longer[last], 0.5))
        sums = [np.bincount(doc, x, len(sizes)) for x in (whole, total, open_)]
        return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.float64)), pa.array(sums[2].astype(np.int64))], names=names)

    return score


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, n_words, n_known (n-grams of the full order that other documents have), log_score (natural, per word), for each row.

    Words are split at ASCII white space, A-Z lower-cased. The score of a word after its history is the count of both
    over the count of the history; where other documents don't have the n-gram, BACKOFF times the score after a
    history shorter by one word; at last its count over the words of all other documents, an unknown word counting
    0.5. Texts that are null or have no words score null; rows of a null key are scored like others. Rows that repeat,
    also a whole table read twice, are documents of their own, so exact copies know each other. Keys are integers; other
    types are refused. Extra columns are not read. Memory: a chunk, or a range of hashes, at a time, however long words
    are; a document of more words than a chunk has is one chunk.
    """
    if order < 2:
        raise ValueError("order is at least 2")
    source = stable(docs.select(integral(docs, key).alias("_id"), F.col(text).cast("string").alias("_text")))
    size = source.agg(F.sum(F.octet_length("_text")).alias("b")).first()["b"] or 0
    bits = max(2, (max(1, size // PARTITION_BYTES) - 1).bit_length())
    exploded = source.mapInArrow(lean(_explode(order, bits)), ROW_SQL)
    counted = exploded.repartitionById(1 << bits, F.col("part")).sortWithinPartitions("n").mapInArrow(lean(_count_and_join), ROW_SQL)
    words = source.mapInArrow(lean(_words), WORDS_SQL)
    names = ["_id", "n_words", "n_known", "part_score", "n_last"]
    scored = counted.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_score(order, names), "_id long, n_words long, n_known long, part_score double, n_last long")
    scored = cut(scored)
    every = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    rest = F.greatest(F.lit(every) - F.col("n_words"), F.lit(1)).cast("double")
    score = F.round((F.col("part_score") - F.col("n_last") * F.log(rest)) / F.col("n_words"), 4)
    return scored.select(F.col("_id").alias(key), "n_words", "n_known", F.when(F.col("n_words") > 0, score).alias("log_score"))


def oracle() -> str:
    """DuckDB SQL for score_documents(documents)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT rid, unnest(w) AS c, unnest(list_prepend(NULL, w)[1:len(w)]) AS b, unnest(list_prepend(NULL, list_prepend(NULL, w))[1:len(w)]) AS a FROM d WHERE len(w) > 0),
n1 AS (SELECT c, count(*) AS n FROM t GROUP BY c), o1 AS (SELECT rid, c, count(*) AS n FROM t GROUP BY rid, c),
n2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c), o2 AS (SELECT rid, b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY rid, b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c), o3 AS (SELECT rid, a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY rid, a, b, c),
total AS (SELECT count(*) AS n FROM t),
own AS (SELECT rid, count(*) AS n FROM t GROUP BY rid),
s AS (SELECT t.rid, t.a, t.b, coalesce(n3.n - o3.n, 0) AS abc, h2.n - g2.n AS ab, coalesce(n2.n - o2.n, 0) AS bc, h1.n - g1.n AS just_b, n1.n - o1.n AS just_c, greatest((SELECT n FROM total) - own.n, 1) AS rest
  FROM t JOIN own USING (rid) JOIN n1 ON n1.c = t.c JOIN o1 ON o1.rid = t.rid AND o1.c = t.c
  LEFT JOIN n2 ON n2.b = t.b AND n2.c = t.c LEFT JOIN o2 ON o2.rid = t.rid AND o2.b = t.b AND o2.c = t.c
  LEFT JOIN n3 ON n3.a = t.a AND n3.b = t.b AND n3.c = t.c LEFT JOIN o3 ON o3.rid = t.rid AND o3.a = t.a AND o3.b = t.b AND o3.c = t.c
  LEFT JOIN n1 h1 ON h1.c = t.b LEFT JOIN o1 g1 ON g1.rid = t.rid AND g1.c = t.b
  LEFT JOIN n2 h2 ON h2.b = t.a AND h2.c = t.b LEFT JOIN o2 g2 ON g2.rid = t.rid AND g2.b = t.a AND g2.c = t.b),
r AS (SELECT rid, count(*)::BIGINT AS n_words, sum((abc > 0)::BIGINT)::BIGINT AS n_known,
  round(sum(CASE WHEN abc > 0 THEN ln(abc) - ln(ab) ELSE CASE WHEN a IS NULL THEN 0 ELSE ln({BACKOFF}) END
    + CASE WHEN bc > 0 THEN ln(bc) - ln(just_b) ELSE CASE WHEN b IS NULL THEN 0 ELSE ln({BACKOFF}) END + ln(greatest(just_c, 0.5)) - ln(rest) END END) / count(*), 4) AS log_score FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_known, 0)::BIGINT AS n_known, log_score FROM d LEFT JOIN r USING (rid)"""
