"""TF-IDF top-k search over packed records: the same pairs and ranks as blocking.searched(blocking.weighted(...)).

Token rows are many times larger than the texts that they come from, so no table of them is made. Records travel in
chunks of compressed text, and a chunk's tokens are made again where they are needed:

1. Each chunk sends its distinct tokens, as 64-bit hashes with the country in them, to buckets of the hash range.
2. A bucket counts them and answers each chunk in the order of its tokens: the document frequency, negative where a
   token is on one side only, so it counts for lengths but can't make a pair, and 0 outside the gate.
3. A chunk then sends each country's side as postings (a token, its frequency, its records) to blocks. Side 1 is cut as
   little as memory allows and side 2 into a few parts, so a record is sent to few blocks.
4. Where two blocks meet, each record of side 1 is scored against all of side 2 at once, and the first k of either
   search leave. Pairs that share a token never do otherwise.

Cosines of given pairs go the same way (`cosines`): a chunk sends only the records that have pairs, and a record of side 1
to no other blocks of side 2 than those of its pairs.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Kept, sound_key
from ..sources.session import cut

SCORE_FLOOR = 1e-9
#: Characters of text in a chunk, and records at most.
CHUNK, MOST_RECORDS = 6_000_000, 8_192
#: Records of either side in a block at most, of side 2 at least; between, side 2 of a country has PARTS blocks at most.
MOST, LEAST, PARTS = (25_000, 50_000), 1000, 8
#: Address words whose hashes are kept; their letters are CHUNK at most, or those of one text.
MOST_WORDS = 250_000
#: Records of side 2 whose pairs are scored in one place: at most, and at least; between, a country has PARTS places.
MOST_PAIRED, LEAST_PAIRED = 50_000, 500
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
#: Matches that are added up at a time: few enough for a core's own cache.
MATCHES = 65_536


def _mix(a: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        a = (a ^ (a >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return a ^ (a >> np.uint64(32))


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode())


def _is_number(t: str) -> bool:
    return t.isascii() and t.isdigit()


def _bare(t: str) -> str:
    return t.lstrip("0") or "0"


class _Places(dict):
    """Address word -> its place in arrays of hashes: among neighbours, as a token of its own (0 if it is none); and whether it is a number."""

    def __init__(self):
        super().__init__()
        self.letters = 0
        self.near, self.alone, self.number = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def __missing__(self, t: str) -> int:
        at = self[t] = len(self)
        if at >= len(self.near):
            self.near, self.alone, self.number = (np.concatenate([x, np.zeros_like(x)]) for x in (self.near, self.alone, self.number))
        self.letters += len(t)
        self.number[at] = n = _is_number(t)
        self.near[at] = _hash(_bare(t) if n else t)
        self.alone[at] = _hash("#" + _bare(t)) if n else self.near[at] if len(t) >= 3 else 0
        return at


class Tokens:
    """Distinct token hashes of records by retriever; two tokens of functions.tokens are equal if and only if their hashes are (but for chance)."""

    def __init__(self, retriever: str):
        if retriever not in ("uni", "combo", "combo_ph", "name_words", "addr_words"):
            raise ValueError(f"no packed form of retriever {retriever}")
        self.retriever = retriever
        self.of, self.key, self.places = Kept(_hash), Kept(sound_key), _Places()

    def _hashes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    @staticmethod
    def _neighbours(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(_mix(h[:-1] + np.uint64(0x632BE59BD9B4E019)) + h[1:])

    def __call__(self, name: str, core: str, address: str) -> np.ndarray:
        c, a = [t for t in core.split(" ") if t], [t for t in address.split(" ") if t]
        if self.retriever in ("name_words", "addr_words"):
            return distinct(self._hashes(c if self.retriever == "name_words" else a))
        if len(self.places) > MOST_WORDS or self.places.letters > CHUNK:
            self.places = _Places()
        places = self.places
        at = np.fromiter(map(places.__getitem__, a), dtype=np.int64, count=len(a))
        few, made = [*c, core.replace(" ", ""), name.replace(" ", "")], [places.alone[at]]
        if self.retriever != "uni":
            nums = [_bare(a[i]) for i in np.flatnonzero(places.number[at])[:4]]
            few += [f"{x}#{n}" for x in c[:4] for n in nums]
            made += [self._neighbours(places.near[at]), self._neighbours(self._hashes(c))]
        if self.retriever == "combo_ph":
            keys = [k for t in c if not _is_number(t) and (k := self.key[t])]
            few += [f"~{k}" for k in keys if len(k) >= 2] + [f"~{x}_{y}" for x, y in zip(keys, keys[1:], strict=False)] + [f"~{k}#{n}" for k in keys[:4] for n in nums]
        found = distinct(np.concatenate([*made, self._hashes([t for t in few if t])]))
        return found[1:] if len(found) and not found[0] else found


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own way by hashes takes several times as long."""
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each item among them."""
    by = np.argsort(a)
    s = a[by]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    place = np.empty(len(a), dtype=np.int64)
    place[by] = np.cumsum(new) - 1
    return s[new], place


def arranged(group: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Items by group and then by size, both below 2 ** 31."""
    return (np.sort(group.astype(np.int64) << 32 | item) & 0xFFFFFFFF).astype(np.int32)


def planes(a: np.ndarray) -> bytes:
    """An array's bytes by place, compressed: the high ones, nearly all equal, lie together. Its number of bytes comes first."""
    flat = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def unplaned(b: bytes, kind) -> np.ndarray:
    size, n = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    flat = pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(flat, dtype=np.uint8).reshape(n, -1).T).view(kind).ravel()


def streamed(table: pa.Table) -> bytes:
    """A table as one compressed Arrow stream; `tables` reads it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def tables(batches, column: str):
    for batch in batches:
        for blob in batch.column(column):
            yield pa.ipc.open_stream(pa.py_buffer(blob.as_py())).read_all()


FIELDS = ["country_key", "side", "entity_id", "name_n", "name_core", "addr_n"]


def chunks(prepared: DataFrame) -> DataFrame:
    """(chunk, number, records): records of a partition as compressed Arrow streams."""

    def run(batches):
        held, size, made = [], 0, 0
        place = TaskContext.get().partitionId()

        def pack():
            blob = streamed(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(place << 24) + made], pa.int64()), pa.array([place + made], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "number", "records"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                held.append(part)
                size += sum(pc.sum(pc.binary_length(part.column(c))).as_py() or 0 for c in ("name_n", "addr_n"))
                if size >= CHUNK or sum(map(len, held)) >= MOST_RECORDS:
                    yield pack()
                    held, size, made = [], 0, made + 1
        if held:
            yield pack()

    return prepared.select(*FIELDS).mapInArrow(run, "chunk long, number long, records binary")


def _tokens_of(blob: bytes, make: Tokens):
    """(records, distinct sorted hashes, place of each token among them, its record) of a chunk."""
    table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all()
    own = [make(*row) for row in zip(*(table.column(c).to_pylist() for c in ("name_n", "name_core", "addr_n")), strict=True)]
    n = np.array([len(x) for x in own], dtype=np.int64)
    record = np.repeat(np.arange(len(own)), n)
    country = np.array([_hash("country " + c) for c in table.column("country_key").to_pylist()], dtype=np.uint64)
    flat = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
    return table, *numbered(_mix(flat ^ country[record])), record


def _send(retriever: str, buckets: int):
    def run(batches):
        make = Tokens(retriever)
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("records"), strict=True):
                table, tokens, place, record = _tokens_of(blob.as_py(), make)
                side = table.column("side").to_numpy()[record]
                n = [np.bincount(place[side == s], minlength=len(tokens)).astype(np.int32) for s in (1, 2)]
                edges = np.searchsorted((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1, dtype=np.uint64))
                some = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                cuts = [slice(edges[b], edges[b + 1]) for b in some]
                t = [planes(np.diff(tokens[c], prepend=np.uint64(0))) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(t, pa.binary()), *(pa.array([planes(x[c]) for c in cuts], pa.binary()) for x in n)], names=["bucket", "chunk", "t", "n1", "n2"])

    return run


def _count(least_df: int, max_df: int | None):
    def run(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(unplaned(b.as_py(), np.uint64), dtype=np.uint64) for b in table.column("t")]
        tokens, place = numbered(np.concatenate(lists))
        n1, n2 = (np.bincount(place, np.concatenate([unplaned(b.as_py(), np.int32) for b in table.column(c)]), len(tokens)).astype(np.int32) for c in ("n1", "n2"))
        df = n1 + n2
        code = np.where((n1 > 0) & (n2 > 0), df, -df)
        code[(df < least_df) | (df > (max_df or np.inf))] = 0
        found, ends = code[place], np.cumsum([0, *map(len, lists)])
        out = [planes(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"chunk_b": table.column("chunk"), "bucket": table.column("bucket"), "df": pa.array(out, pa.binary())})

    return run


def _frequencies(answers: pa.Table) -> np.ndarray:
    """A chunk's document frequencies, in the order of its tokens."""
    by, df = np.argsort(answers.column("bucket").to_numpy()), answers.column("df").combine_chunks()
    return np.concatenate([unplaned(df[int(i)].as_py(), np.int32) for i in by]) if len(by) else np.zeros(0, np.int32)


def inverse_frequency(n, df):
    return np.log((n + 1) / (df + 1)) + 1


def _post(retriever: str, sizes: dict[str, tuple[int, int, int]], kind: pa.DataType):
    """A chunk and the frequencies of its tokens -> its postings by country and side, with the number of its block and of those that it meets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        make, rows = Tokens(retriever), []
        for number, blob in zip(left.column("number").to_pylist(), left.column("records"), strict=True):
            table, tokens, place, record = _tokens_of(blob.as_py(), make)
            df = _frequencies(right)
            if len(df) != len(tokens):
                raise RuntimeError("a chunk's tokens and their frequencies differ in number")
            keys, side, ids = table.column("country_key").to_pylist(), table.column("side").to_numpy(), table.column("entity_id").combine_chunks()
            n = np.array([sizes[k][0] for k in keys], dtype=np.float64)
            own = df[place]
            idf = np.where(own != 0, inverse_frequency(n[record], np.abs(own)), 0.0)
            square = np.bincount(record, idf * idf, len(keys))
            there = own > 0
            groups: dict = {}
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(keys, side.tolist(), strict=True)], dtype=np.int64)
            for (country, s), g in groups.items():
                of = np.flatnonzero(there & (group[record] == g))
                if not len(of):
                    continue
                used, local = numbered(record[of])
                count = np.bincount(place[of], minlength=len(tokens))
                at = np.flatnonzero(count)
                _, p1, p2 = sizes[country]
                mine, others = (number % p1, p2) if s == 1 else (number % p2, p1)
                rows.append((country, s, mine, others, ids.take(pa.array(used)), (1 / np.sqrt(square[used])).tobytes(), planes(np.diff(tokens[at], prepend=np.uint64(0))), planes(df[at]), planes(count[at].astype(np.int32)), planes(arranged(place[of], local))))
        kinds = {"country_key": pa.string(), "side": pa.int32(), "own": pa.int32(), "others": pa.int32(), "ids": pa.list_(kind), "length": pa.binary(), "t": pa.binary(), "df": pa.binary(), "n": pa.binary(), "record": pa.binary()}
        columns = {c: [r[k] for r in rows] for k, c in enumerate(kinds)}
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns["ids"])]), pa.int32()), pa.concat_arrays([pa.array([], kind), *columns["ids"]]))
        return pa.table({c: lists if c == "ids" else pa.array(x, kinds[c]) for c, x in columns.items()})

    return run


class _Side:
    """Postings of one block: ids in ascending order, inverse lengths, and per posting its token and record."""

    def __init__(self, table: pa.Table, end: str = ""):
        ids = pa.concat_arrays([x.flatten() for x in table.column("ids" + end).chunks])
        order = pc.sort_indices(ids).to_numpy()  # the lower id wins ties, so records go by id
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        self.ids = ids.take(pa.array(order))
        read = lambda c, kind: [unplaned(b.as_py(), kind) for b in table.column(c + end)]
        self.length = np.concatenate([np.frombuffer(b.as_py()) for b in table.column("length" + end)])[order]
        starts = np.cumsum([0, *(len(b.as_py()) // 8 for b in table.column("length" + end))])
        self.token = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read("t", np.uint64)])  # distinct in a chunk, not in a block
        self.df, self.n = np.concatenate(read("df", np.int32)), np.concatenate(read("n", np.int32))
        self.record = rank[np.concatenate([x.astype(np.int64) + s for x, s in zip(read("record", np.int32), starts, strict=False)])].astype(np.int32)


def _meet(k_forward: int, k_reverse: int, sizes: dict[str, tuple[int, int, int]]):
    """A function of two blocks: the first k_forward of each record of side 1 (f), and the first k_reverse of each of side 2 (r)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"pairs": pa.array([], pa.binary())})
        if not len(left) or not len(right):
            return empty
        country = key[0].as_py()
        a, b = _Side(left), _Side(right, "_b")
        tokens, place = numbered(b.token)
        df = np.empty(len(tokens), dtype=np.int64)
        df[place] = b.df
        value = inverse_frequency(sizes[country][0], df) ** 2
        place = np.repeat(place, b.n)
        by_token = arranged(place, b.record)
        count = np.bincount(place, minlength=len(tokens))
        first = np.cumsum(count) - count
        del place
        at = np.searchsorted(tokens, a.token)
        at[at == len(tokens)] = 0
        known = np.repeat(tokens[at] == a.token, a.n)
        token, record = np.repeat(at, a.n)[known], a.record[known]
        token, ends = arranged(record, token), np.cumsum(np.bincount(record, minlength=len(a.ids)))
        size = len(b.ids)
        best, who, exact = np.full((k_reverse, size), -1.0), np.zeros((k_reverse, size), dtype=np.int64), np.zeros((k_reverse, size))
        found = []
        for i in range(len(a.ids)):
            mine = token[ends[i - 1] if i else 0 : ends[i]]
            if not len(mine):
                continue
            n = count[mine]
            total = np.cumsum(n)
            score, x = np.zeros(size), 0
            while x < len(mine):  # so many tokens that their matches are MATCHES at most
                y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + MATCHES, "right")))
                c = n[x:y]
                where = np.repeat(first[mine[x:y]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                score += np.bincount(by_token[where], np.repeat(value[mine[x:y]], c), size)
                x = y
            score *= a.length[i]
            score *= b.length
            some = np.flatnonzero(score > SCORE_FLOOR)
            score = score[some]
            q = np.floor(score * 1e6 + 0.5)
            top = np.arange(len(q))
            if len(q) > k_forward:
                top = np.flatnonzero(q >= np.partition(q, len(q) - k_forward)[len(q) - k_forward])
            top = top[np.argsort(-q[top], kind="stable")[:k_forward]]
            found.append((np.full(len(top), i), some[top], score[top]))
            better = q > best[-1, some]
            at, cur, cur_who, cur_exact = some[better], q[better], np.full(better.sum(), i), score[better]
            moved = np.zeros(len(at), dtype=bool)
            for r in range(k_reverse):  # an earlier record stays ahead of an equal one; whoever is passed moves down
                moved |= cur > best[r, at]
                for held, new in ((best, cur), (who, cur_who), (exact, cur_exact)):
                    old = held[r, at]
                    held[r, at] = np.where(moved, new, old)
                    new[moved] = old[moved]
        if not found:
            return empty
        r, c = np.nonzero(best >= 0)
        parts = [tuple(np.concatenate(x) for x in zip(*found, strict=True)), (who[r, c], c, exact[r, c])]
        i, j, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        f = np.arange(len(i)) < len(parts[0][0])
        return pa.table({"pairs": pa.array([streamed(pa.table({"country_key": pa.repeat(country, len(i)), "s1_id": a.ids.take(pa.array(i)), "cand_id": b.ids.take(pa.array(j)), "score": score, "f": f}))], pa.binary())})

    return run


def ids_are_keys(held: DataFrame, kind: str) -> bool:
    """No id is null or repeats."""

    def run(batches):
        for t in tables(batches, "records"):
            yield from t.select(["entity_id"]).to_batches()

    n = held.select("records").mapInArrow(run, f"entity_id {kind}").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("d")).first()
    return n["n"] == n["d"]


def forget(spark) -> None:
    """Files of shuffles and checkpoints that nothing refers to go now; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what Python lets go is let go by the JVM a moment later
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _counted(held: DataFrame, retriever: str, least_df: int, max_df: int | None) -> DataFrame:
    """(chunk_b, bucket, df): what each bucket answers each chunk."""
    spark = held.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    sent = held.mapInArrow(_send(retriever, buckets), "bucket int, chunk long, t binary, n1 binary, n2 binary")
    return sent.groupBy("bucket").applyInArrow(_count(least_df, max_df), "chunk_b long, bucket int, df binary")


def found_in(held: DataFrame, kind: str, retriever: str, least_df: int, max_df: int | None, k_forward: int, k_reverse: int) -> DataFrame:
    """(country_key, s1_id, cand_id, score, f, r) of chunks whose ids are of a kind: what can be among the first of the forward search (f) or of the reverse one (r).

    A row per country passes through the driver: its number of records and of blocks.
    """
    spark = held.sparkSession
    sizes, counts = {}, _sizes(held).groupBy("country_key").agg(F.sum("n1"), F.sum("n2")).collect()
    parts = min(PARTS, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(counts))))  # side 1 is sent to each, so no more than keep all cores busy
    for c, n1, n2 in counts:
        sizes[c] = (n1 + n2, max(1, -(-n1 // MOST[0])), max(1, -(-n2 // MOST[1]), min(parts, -(-n2 // LEAST))))
    counted = _counted(held, retriever, least_df, max_df)
    posted = held.groupBy("chunk").cogroup(counted.groupBy("chunk_b")).applyInArrow(_post(retriever, sizes, ARROW[kind]), f"country_key string, side int, own int, others int, ids array<{kind}>, length binary, t binary, df binary, n binary, record binary")
    posted = cut(posted)
    del counted
    forget(spark)  # the files of the two shuffles
    others = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    packed = ["ids", "length", "t", "df", "n", "record"]
    a = posted.where("side = 1").select("country_key", F.col("own").alias("i"), others.alias("j"), *packed)
    b = posted.where("side = 2").select(F.col("country_key").alias("country_b"), others.alias("i_b"), F.col("own").alias("j_b"), *[F.col(c).alias(f"{c}_b") for c in packed])
    met = a.groupBy("country_key", "i", "j").cogroup(b.groupBy("country_b", "i_b", "j_b"))
    pairs = cut(met.applyInArrow(_meet(k_forward, k_reverse, sizes), "pairs binary"))  # read twice

    def unpacked(batches):
        for t in tables(batches, "pairs"):
            yield from t.to_batches()

    return pairs.mapInArrow(unpacked, f"country_key string, s1_id {kind}, cand_id {kind}, score double, f boolean").withColumn("r", ~F.col("f"))


def _sizes(held: DataFrame) -> DataFrame:
    """(country_key, n1, n2) of each chunk."""

    def run(batches):
        for t in tables(batches, "records"):
            t = t.select(["country_key", "side"])
            t = t.append_column("n1", pc.cast(pc.equal(t["side"], 1), pa.int64())).append_column("n2", pc.cast(pc.equal(t["side"], 2), pa.int64()))
            yield from t.group_by("country_key").aggregate([("n1", "sum"), ("n2", "sum")]).rename_columns(["country_key", "n1", "n2"]).cast(pa.schema([("country_key", pa.string()), ("n1", pa.int64()), ("n2", pa.int64())])).to_batches()

    return held.mapInArrow(run, "country_key string, n1 long, n2 long")


def _post_paired(retriever: str, sizes: dict[str, int], kind: pa.DataType):
    """A chunk, the frequencies of its tokens and the places of its records (bucket -1) -> postings by country, place and side."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        make, rows = Tokens(retriever), []
        wanted = pc.equal(right.column("bucket"), -1)
        needs, df = right.filter(wanted), _frequencies(right.filter(pc.invert(wanted)))
        for blob in left.column("records") if len(needs) else []:
            table, tokens, place, record = _tokens_of(blob.as_py(), make)
            if len(df) != len(tokens):
                raise RuntimeError("a chunk's tokens and their frequencies differ in number")
            keys, side, ids = table.column("country_key").to_pylist(), table.column("side").to_numpy(), table.column("entity_id").combine_chunks()
            who = pc.index_in(needs.column("ids").combine_chunks().flatten(), ids).to_numpy()
            j = needs.column("js").combine_chunks().flatten().to_numpy()
            own = df[place]
            idf = np.where(own != 0, inverse_frequency(np.array([sizes[k] for k in keys], dtype=np.float64)[record], np.abs(own)), 0.0)
            square = np.bincount(record, idf * idf, len(keys))
            groups: dict = {}
            for r, at in zip(who.tolist(), j.tolist(), strict=True):
                groups.setdefault((keys[r], int(side[r]), at), []).append(r)
            for (country, s, at), records in groups.items():
                mine = np.zeros(len(keys), dtype=bool)
                mine[records] = True
                of = np.flatnonzero((own > 0) & mine[record])
                if not len(of):
                    continue
                used, local = numbered(record[of])
                count = np.bincount(place[of], minlength=len(tokens))
                t = np.flatnonzero(count)
                rows.append((country, at, s, ids.take(pa.array(used)), (1 / np.sqrt(square[used])).tobytes(), planes(np.diff(tokens[t], prepend=np.uint64(0))), planes(df[t]), planes(count[t].astype(np.int32)), planes(arranged(place[of], local))))
        kinds = {"country_key": pa.string(), "j": pa.int32(), "side": pa.int32(), "ids": pa.list_(kind), "length": pa.binary(), "t": pa.binary(), "df": pa.binary(), "n": pa.binary(), "record": pa.binary()}
        columns = {c: [r[k] for r in rows] for k, c in enumerate(kinds)}
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns["ids"])]), pa.int32()), pa.concat_arrays([pa.array([], kind), *columns["ids"]]))
        return pa.table({c: lists if c == "ids" else pa.array(x, kinds[c]) for c, x in columns.items()})

    return run


def _score_pairs(sizes: dict[str, int]):
    """A function of the postings of a place and of its pairs: the pairs with their cosines."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        score = np.zeros(len(right))
        sides = [left.filter(pc.equal(left.column("side"), s)) for s in (1, 2)]
        if len(right) and all(map(len, sides)):
            a, b = map(_Side, sides)
            tokens, place = numbered(np.concatenate([a.token, b.token]))
            df = np.empty(len(tokens), dtype=np.int64)
            df[place] = np.concatenate([a.df, b.df])
            value = inverse_frequency(sizes[key[0].as_py()], df) ** 2
            own = [arranged(x.record, np.repeat(p, x.n)) for x, p in ((a, place[: len(a.token)]), (b, place[len(a.token) :]))]
            size = [np.bincount(x.record, minlength=len(x.ids)) for x in (a, b)]
            end = [np.cumsum(n) for n in size]
            i, j = (pc.fill_null(pc.index_in(right.column(c).combine_chunks(), x.ids), -1).to_numpy() for c, x in (("s1_id", a), ("cand_id", b)))
            by = np.argsort(i, kind="stable")
            by = by[(i[by] >= 0) & (j[by] >= 0)]  # others share no token
            here = np.zeros(len(tokens))
            for pairs in np.split(by, np.flatnonzero(np.diff(i[by])) + 1) if len(by) else []:
                record = i[pairs[0]]
                mine = own[0][end[0][record] - size[0][record] : end[0][record]]
                here[mine] = value[mine]
                for at in range(0, len(pairs), 256):
                    p = pairs[at : at + 256]
                    n = size[1][j[p]]
                    where = np.repeat(end[1][j[p]] - np.cumsum(n), n) + np.arange(n.sum())
                    score[p] = np.bincount(np.repeat(np.arange(len(p)), n), here[own[1][where]], len(p)) * a.length[record] * b.length[j[p]]
                here[mine] = 0
        return pa.table({"s1_id": right.column("s1_id"), "cand_id": right.column("cand_id"), "value": score})

    return run


def located(held: DataFrame, kind: str) -> DataFrame:
    """(entity_id, chunk, country_key, side) of the records of chunks."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("records"), strict=True):
                t = pa.ipc.open_stream(pa.py_buffer(blob.as_py())).read_all().select(["entity_id", "country_key", "side"])
                yield from t.append_column("chunk", pa.repeat(chunk, len(t))).select(["entity_id", "chunk", "country_key", "side"]).to_batches()

    return held.mapInArrow(run, f"entity_id {kind}, chunk long, country_key string, side int")


def cosines(held: DataFrame, kind: str, pairs: DataFrame, retrievers: dict[str, str], least_df: int, max_df: int | None) -> DataFrame | None:
    """(s1_id, cand_id and a cosine for each retriever by name) of given pairs of records in chunks, of side 1 and side 2, without a row per token.

    None if a pair is across countries, whose tokens aren't those of one another here. A row per country passes through the driver.
    """
    spark, pairs = held.sparkSession, pairs.select("s1_id", "cand_id").distinct()
    n = cut(_sizes(held).groupBy("country_key").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")))
    sizes = {c: n1 + n2 for c, n1, n2 in n.collect()}
    parts = F.greatest(F.lit(1), F.ceil(F.col("n2") / MOST_PAIRED), F.least(F.lit(PARTS), F.ceil(F.col("n2") / LEAST_PAIRED))).cast("int")
    at = cut(located(held, kind).join(n.select("country_key", parts.alias("parts")), "country_key"))
    a = at.where("side = 1").select(F.col("entity_id").alias("s1_id"), F.col("chunk").alias("chunk_a"), "country_key")
    b = at.where("side = 2").select(F.col("entity_id").alias("cand_id"), F.col("chunk").alias("chunk_b"), F.col("country_key").alias("country_b"), F.pmod(F.xxhash64("entity_id"), "parts").cast("int").alias("j"))
    placed = cut(pairs.join(a, "s1_id").join(b, "cand_id"))
    if not placed.where("country_key <> country_b").isEmpty():
        return None
    both = placed.select(F.col("chunk_a").alias("chunk_b"), "j", F.col("s1_id").alias("id")).union(placed.select("chunk_b", "j", F.col("cand_id").alias("id"))).distinct()
    needs = cut(both.groupBy("chunk_b").agg(F.collect_list(F.struct("j", "id")).alias("x")).select("chunk_b", F.lit(-1).alias("bucket"), F.col("x.j").alias("js"), F.col("x.id").alias("ids")))
    made = placed.select("s1_id", "cand_id")
    for out, retriever in retrievers.items():
        answers = _counted(held, retriever, least_df, max_df).unionByName(needs, allowMissingColumns=True)
        posted = held.groupBy("chunk").cogroup(answers.groupBy("chunk_b")).applyInArrow(_post_paired(retriever, sizes, ARROW[kind]), f"country_key string, j int, side int, ids array<{kind}>, length binary, t binary, df binary, n binary, record binary")
        here = placed.select(F.col("country_key").alias("country_c"), F.col("j").alias("j_c"), "s1_id", "cand_id")
        scored = cut(posted.groupBy("country_key", "j").cogroup(here.groupBy("country_c", "j_c")).applyInArrow(_score_pairs(sizes), f"s1_id {kind}, cand_id {kind}, value double"))
        made = made.join(scored.withColumnRenamed("value", out), ["s1_id", "cand_id"])
        del answers, posted
        forget(spark)  # the files of the shuffles
    return made
