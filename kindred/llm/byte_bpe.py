"""Byte-level BPE encoding and decoding (operator 9).

A rank file (base64 of a token's bytes, its rank) becomes a sentencepiece BPE model: each byte is mapped to
one character, each token to the piece of its mapped bytes with score -rank, so that the merge of the lowest
rank is the piece of the highest score. Normalisation is the identity. Pre-tokens are encoded one by one and
decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED, lean, slices

#: Byte b is the character U+0100 + b: letters that no normaliser touches.
SHIFT = 0x100
#: Pre-tokens whose ids a worker keeps before it starts anew; long ones are not kept.
CACHE = 200_000
TYPES = {"ids": "array<bigint>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file. Ranks are the ids, so they have to be 0..n-1."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the ranks of a vocabulary have to be 0..n-1, each once")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"a byte-level vocabulary has all 256 bytes; missing: {missing[:5]}")
    return ranks


def mapped(token: bytes) -> str:
    return "".join(chr(SHIFT + b) for b in token)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - SHIFT for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffer message: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto: pieces (1: text, 2: score, 3: type), trainer (2) and normaliser (3) settings."""
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-r)) + _field(3, normal)) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    out.append(_field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes with a rank file's bytes and the pattern of its pre-tokens."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(ranks_file)
        self.pretokens = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.inverse = [unmapped(self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = [self.pretokens(t) for t in texts]
        new = [t for t in set().union(*found) if t not in self.cache]
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        merged = []
        for token, b in zip(new, raw, strict=True):
            if (rank := self.ranks.get(b)) is not None:  # a pre-token that is a token is taken whole, even if no merges lead to it
                self.cache[token] = struct.pack("<I", rank)
            else:
                merged.append((token, b))
        ids = self.model.encode([mapped(b) for _, b in merged], num_threads=1) if merged else []
        for (token, _), x in zip(merged, ids, strict=True):
            self.cache[token] = np.array(x, dtype="<u4").tobytes()
        get = self.cache.__getitem__
        out = [b"".join(map(get, x)) for x in found]
        for token in new:
            if len(token) > CACHED:
                del self.cache[token]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.inverse.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def code_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "n_tokens"), text: str = "text") -> DataFrame:
    """Encode and decode every whole text, one row per row.

    outputs: any of ids, decoded (the bytes the ids stand for), n_tokens, ids_sha256, decoded_sha256. Null and empty
    texts have no ids. Texts and words of any length are encoded whole. Repeated rows give repeated results, null keys
    stay; columns outside `keep` are not read, and one in it that is named like an output is refused. A narrow job: no
    shuffle, and a lost executor's partitions are simply computed again.
    """
    if clash := {*keep} & {*outputs}:
        raise ValueError(f"columns to keep are named like outputs: {sorted(clash)}")
    held = "_text"
    while held in keep:
        held = f"_{held}"
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()
    read_ranks(ranks_file)
    source = docs.select(*keep, F.col(text).cast("string").alias(held))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + [f"{c} {TYPES[c]}" for c in outputs])

    def run(batches):
        codec = Codec(ranks_file, pattern)

        def coded(batch):
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                made = {c: [] for c in outputs}
                for (texts,) in slices([part.select([held])], (held,), held):
                    for ids in codec.encode([t or "" for t in texts]):
                        decoded = codec.decode(ids) if {"decoded", "decoded_sha256"} & {*outputs} else b""
                        for c in outputs:
                            made[c].append(
                                np.frombuffer(ids, dtype="<u4").astype(np.int64) if c == "ids" else decoded if c == "decoded" else len(ids) // 4 if c == "n_tokens" else hashlib.sha256(ids if c == "ids_sha256" else decoded).hexdigest()
                            )
                kinds = {"ids": pa.list_(pa.int64()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
                arrays = [part.column(c) for c in keep] + [pa.array(made[c], kinds[c]) for c in outputs]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *outputs])

        for batch in batches:
            yield from coded(batch)

    return source.mapInArrow(lean(run), schema)
