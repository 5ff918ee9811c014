"""Token ids in Arrow files of equal-length sequences (operator 10).

A shard is one Arrow IPC file: record batches of `ids` and `mask`, both fixed-size lists of the sequence length,
uncompressed, so that sequence i is at a known place and a memory map gives it without a copy. Beside it lies an
index file (doc_id, start, n_tokens). Documents follow one another in ascending doc_id; tasks have consecutive ranges
of doc_id and write one shard after the other, each of which begins a sequence of its own, the last one padded under a
false mask.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CACHED, cut, integral, lean, slices

#: Tokens in a sequence, sequences in a record batch, tokens after which a shard is closed.
LENGTH, BATCH, SHARD_TOKENS = 2048, 64, 8 << 20
#: Text bytes that a range of doc_id aims at, and ranges at most: a range is a task that sorts on disk and writes as
#: many shards as it needs, so with more text ranges get longer, nothing else.
RANGE_BYTES, RANGES = 16 << 20, 20_000
#: Words whose ids a worker keeps before it starts anew; long ones are not kept.
CACHE = 800_000
#: Where rows of a null doc_id are sorted: before all others.
NO_ID = -(1 << 63)


class Encoder(dict):
    """Ids by a `tokenizers` file, by way of the pieces between spaces and line feeds.

    For tokenizers whose pre-tokens hold no white space, encoding these pieces separately equals encoding the whole
    text. Each piece goes through the library once per cache: common lower-case words straight to its BPE model,
    all others through the whole tokenizer. What the short ways rely on is tried on the file itself by `suits`.
    """

    #: Words that are one pre-token and that normalisation leaves alone: ASCII and Latin-1 small letters.
    WORD = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, file: str, kind: np.dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_str(file)
        self.model, self.code = self.tokenizer.model, {2: "H", 4: "I"}[kind.itemsize]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, file: str, kind: np.dtype) -> Encoder:
        """The process's encoder for a file; its cache serves one task after another."""
        key = (zlib.crc32(file.encode()), kind.str)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(file, kind)
        return _ENCODERS[key]

    def suits(self) -> int:
        """Raises unless white space ends pre-tokens, case of A-Z is ignored and words go to the model as they are; returns the number of ids."""
        whole = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        words = [chr(97 + i % 26) * (1 + i % 5) + chr(97 + i * 7 % 26) + "theandßàéñü"[i % 11 :] for i in range(200)]
        ok = all(self.model_ids(w) == whole(w) == whole(w.upper() if w.isascii() else w) and whole(w + ",") == whole(w) + whole(",") and whole(w + ".") == whole(w) + whole(".") for w in words)
        for a, b in (("one", "two"), ("don't", "'s 5"), ("x1", "%%"), ("a.", "é")):
            ok = ok and all(whole(a + space + b) == whole(a) + whole(b) for space in (" ", "\n", "  \n "))
        if not ok:
            raise ValueError("this tokenizer's ids depend on white space or letter case; its texts can't be encoded piecewise")
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def __missing__(self, piece: bytes) -> bytes:
        word = piece.decode("utf-8", "surrogatepass")
        if self.WORD.fullmatch(word):
            ids = self.model_ids(word)
        elif word[-1:] in (",", ".") and self.WORD.fullmatch(word, 0, len(word) - 1):
            ids = None
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        value = self[piece[:-1]] + self[piece[-1:]] if ids is None else array(self.code, ids).tobytes()
        if len(piece) <= CACHED:
            self[piece] = value
        return value

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as integers of the kind, little-endian."""
        if len(self) > CACHE:
            self.clear()
        out, get = [], self.__getitem__
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            low = raw.lower()
            # special tokens heed the case; a capital may not compose with a combining mark (lead bytes CC, CD) where the small letter does
            if b"\xcc" in raw or b"\xcd" in raw or any(s in low for s in self.special):
                low = raw
            out.append(b"".join(map(get, low.replace(b"\n", b" ").split(b" "))))
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def _place(uri: str):
    """File system and path of a folder or file; a scheme other than file:// goes to what pyarrow offers for it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


class ShardWriter:
    """Appends documents to one shard; holds one record batch of tokens at most."""

    def __init__(self, folder: str, part: int, shard: int, kind: np.dtype, length: int):
        self.fs, root = _place(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"shard-{part:06d}-{shard:06d}-{uuid.uuid4().hex}"  # a repeated task writes its own file; the manifest names the one that counts
        self.kind, self.length, self.part, self.shard = kind, length, part, shard
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{root}/{self.name}.arrow"), self.fs.open_output_stream(f"{root}/{self.name}.index.arrow")]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.held, self.held_n, self.total, self.rows, self.docs = [], 0, 0, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.docs += 1
        self.total += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= self.length * BATCH:
            self._flush(False)
        if len(self.rows) >= 50_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([np.zeros(0, self.kind), *self.held])
        step = self.length * BATCH
        whole = len(flat) if last else len(flat) - len(flat) % step
        for at in range(0, whole, step):
            part = flat[at : at + step]
            padded = -(-len(part) // self.length) * self.length
            mask = np.arange(padded) < len(part)
            part = np.concatenate([part, np.zeros(padded - len(part), self.kind)])
            self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)], schema=self.schema))
        self.held, self.held_n = [flat[whole:]], len(flat) - whole

    def _flush_index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.rows, strict=True)], schema=self.index_schema))
            self.rows = []

    def close(self) -> tuple[int, int, str, int, int]:
        self._flush(True)
        self._flush_index()
        for x in (self.data, self.index, *self.sinks):
            x.close()
        return self.part, self.shard, self.name, self.docs, self.total


@contextmanager
def opened(folder: str, name: str):
    """A reader of an Arrow file; a memory map where the folder is local."""
    system, root = _place(folder)
    path = f"{root}/{name}.arrow"
    source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
    try:
        yield pa.ipc.open_file(source)
    finally:
        source.close()


def sequence(folder: str, name: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence i of a shard; the ids are a view of the mapped file."""
    with opened(folder, name) as reader:
        batch = reader.get_batch(i // BATCH)
        return batch.column("ids")[i % BATCH].values.to_numpy(zero_copy_only=True), batch.column("mask")[i % BATCH].values.to_numpy(zero_copy_only=False)


def ranges(docs: DataFrame, text: str) -> np.ndarray:
    """Bounds of the ranges of doc_id, ascending. An id that has more rows than a range should stands there several times."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = min(RANGES, max(1, -(-size // RANGE_BYTES)))
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    found = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NO_ID)), [i / n for i in range(1, n)], 10 * n)).first()[0]
    return np.array(found or [], dtype=np.int64)


def range_of(bounds: np.ndarray, doc_id: int, spread: int) -> int:
    """The range of a row; rows of an id that is several bounds are dealt to the ranges between them by a 64-bit hash, in its order."""
    low, high = int(np.searchsorted(bounds, doc_id, "left")), int(np.searchsorted(bounds, doc_id, "right"))
    return low + (spread * (high - low + 1) >> 64)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Encode every whole text, append end_id, write the shards; returns the manifest (part, shard, name, n_docs, n_tokens).

    Null and empty texts have one id, the end; texts and words of any length are encoded whole. Rows of a null doc_id
    come first; rows of equal doc_id are ordered by a hash of their ids, and so many that they exceed a range are
    dealt to several. doc_id is an integer, other types are refused; other columns are not read. An empty table gives an
    empty manifest. One shuffle moves ids (16-bit where the vocabulary allows), never texts; its bounds come from
    percentiles of doc_id, so no text is encoded twice.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = f.read()
    kind = np.dtype("<u2" if max(Encoder(file, np.dtype("<u4")).suits(), end_id + 1) <= 1 << 16 else "<u4")
    source = docs.select(integral(docs, "doc_id").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    bounds = ranges(source, "_text")

    def encoded(batches):
        encoder, end = Encoder.of(file, kind), np.array([end_id], dtype=kind).tobytes()
        for ids, texts in slices(batches, ("doc_id", "_text"), "_text"):
            coded = [x + end for x in encoder.encode([t or "" for t in texts])]
            spread = [xxhash.xxh3_64_intdigest(x) for x in coded]
            part = [range_of(bounds, NO_ID if i is None else i, h) for i, h in zip(ids, spread, strict=True)]
            spread = [h - (1 << 63) for h in spread]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(spread, pa.int64()), pa.array(coded, pa.binary())], names=["part", "doc_id", "spread", "ids"])

    def written(batches):
        writer, done = None, []
        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if writer is None or writer.part != part or writer.total >= SHARD_TOKENS:
                    done += [writer.close()] if writer else []
                    writer = ShardWriter(folder, part, sum(d[0] == part for d in done), kind, length)
                writer.add(doc_id, np.frombuffer(ids, dtype=kind))
        done += [writer.close()] if writer else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "name", "n_docs", "n_tokens"])

    rows = source.mapInArrow(lean(encoded), "part int, doc_id long, spread long, ids binary")
    ordered = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "spread", "ids")
    return cut(ordered.mapInArrow(lean(written), "part int, shard int, name string, n_docs long, n_tokens long"))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32. The driver adds up one number per range."""
    before, rows = 0, []
    for x in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # RANGES rows at most
        rows.append((x["part"], before))
        before += x["n"]

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with opened(folder, name) as data, opened(folder, f"{name}.index") as index:
                    flat, at, k = np.zeros(0, np.uint16), 0, 0  # ids from position `at` on, next record batch
                    for i in range(index.num_record_batches):
                        out = []
                        for doc_id, start, n in zip(*(c.to_pylist() for c in index.get_batch(i).columns), strict=True):
                            parts = [flat[start - at : start - at + n]]
                            while at + len(flat) < start + n:
                                at += len(flat)
                                flat = data.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
                                k += 1
                                parts.append(flat[max(0, start - at) : start + n - at])
                            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
                            out.append((doc_id, first + start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    own = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.join(starts, "part").select("name", (F.col("before") + own).alias("first"))
    return shards.repartition(max(1, manifest.count())).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
