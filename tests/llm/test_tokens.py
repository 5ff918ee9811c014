"""Byte-level BPE against tiktoken and token files against the tokenizers library, with hard texts."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import byte_bpe, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
HARD = ["", None, "a", " " * 50, "\n\n", "a" * 3000, "'S don't", "x\u0308T\u0308 \u1e97", "<|endoftext|> <|ENDOFTEXT|>", "日本語 ١٢٣ é É ß ẞ Σς", "word, word. word,. 1,000", "\u00a0\u2003tab\there", "the quick brown fox " * 20_000]


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return byte_bpe.Codec(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_codec():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_is_tiktokens_and_decodes(codec, tiktoken_codec, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_codec.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_rows(docs, tiktoken_codec):
    rows = list(enumerate(HARD)) + [(3, " " * 50), (None, "a")]
    d = docs(rows).withColumnRenamed("n_chars", "ids")  # a name that clashes with an output
    got = byte_bpe.code_documents(d, RANKS, P.PATTERN, outputs=("ids", "n_tokens", "decoded", "ids_sha256")).collect()
    assert len(got) == len(rows)
    text = dict(enumerate(HARD)) | {None: "a"}
    for r in got:
        want = tiktoken_codec.encode_ordinary(text[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == (text[r["doc_id"]] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert byte_bpe.code_documents(docs([]), RANKS, P.PATTERN).count() == 0


def test_bpe_refuses_gaps():
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(b"YQ== 0\nYg== 2\n")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_pieces_are_the_librarys(library):
    e = token_files.Encoder(open(WORDS, encoding="utf-8").read(), np.dtype("<u2"))
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'T", "Σ", "ς", "İ", "ß", "ẞ", "\u0301", "\u0308", "e", "E", "T", "K", "ſ", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", ",", ".", "!?", "1", "٣", "é", "É", "ÿ", "中", "😀", "the", "Q"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(e.encode([s])[0], "<u2").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize(("range_bytes", "shard_tokens"), [(1 << 30, 1 << 23), (20_000, 1 << 23), (1 << 30, 300), (3_000, 300)])
def test_files(spark, docs, library, tmp_path, monkeypatch, range_bytes, shard_tokens):
    monkeypatch.setattr(token_files, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(token_files, "SHARD_TOKENS", shard_tokens)
    rows = [(7 * i % 101, t) for i, t in enumerate(HARD)] + [(1000 + i, f"document {i}") for i in range(300)] + [(1000, "document 0"), (None, "no id")]
    manifest = token_files.write_tokens(docs(rows), str(tmp_path), WORDS, 2, length=64)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, str(tmp_path), manifest).collect()), key=lambda r: r[1])
    key = lambda r: (-1 if r[0] is None else r[0])
    at = 0
    for (i, start, n, crc), (j, text) in zip(got, sorted(rows, key=key), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (i, start, n, crc) == (j, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    total = 0
    for m in manifest.collect():
        count = -(-m["n_tokens"] // 64)
        tails = [token_files.sequence(str(tmp_path), m["name"], i) for i in range(count)]
        assert all(len(ids) == 64 for ids, _ in tails) and sum(int(mask.sum()) for _, mask in tails) == m["n_tokens"]
        assert all(mask.all() for _, mask in tails[:-1])
        total += m["n_tokens"]
    assert total == at and (manifest.count() > 1) == (min(range_bytes, shard_tokens) < 1 << 20)


def test_files_of_hot_ids(spark, docs, library, tmp_path, monkeypatch):
    """Rows of one id, and of none, go to several ranges and stay in order."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 500)
    rows = [(7, f"hot row {i}") for i in range(400)] + [(None, f"nameless row {i}") for i in range(400)] + [(i, f"row {i}") for i in range(40)]
    manifest = token_files.write_tokens(docs(rows), str(tmp_path), WORDS, 2, length=16)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert len(sizes) > 10 and max(sizes) < 200 and sum(sizes) == len(rows)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, str(tmp_path), manifest).collect()), key=lambda r: r[1])
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(i), c) for i, _, _, c in got) == sorted((str(i), crc(t)) for i, t in rows)
    ids = [-1 if r[0] is None else r[0] for r in got]
    assert ids == sorted(ids) and [r[1] for r in got[1:]] == [r[1] + r[2] for r in got[:-1]]
    with pytest.raises(TypeError):
        token_files.write_tokens(docs([(1, "a")]).selectExpr("string(doc_id) AS doc_id", "text"), str(tmp_path), WORDS, 2)


def test_long_words_are_not_kept(codec):
    e = token_files.Encoder(open(WORDS, encoding="utf-8").read(), np.dtype("<u2"))
    long = ["ab" * 100_000, "Q9" * 50_000, "short"]
    e.encode(long)
    codec.encode(long)
    assert all(len(x) <= 64 for x in e) and all(len(x) <= 64 for x in codec.cache) and "short" in codec.cache


def test_a_kept_column_named_like_an_output(docs):
    with pytest.raises(ValueError):
        byte_bpe.code_documents(docs([(1, "a")]).withColumnRenamed("n_chars", "ids"), RANKS, P.PATTERN, keep=("doc_id", "ids"))
    d = docs([(1, "a")]).withColumnRenamed("lang", "_text")
    assert byte_bpe.code_documents(d, RANKS, P.PATTERN, keep=("_text",), outputs=("n_tokens",)).collect()[0].asDict() == {"_text": "en", "n_tokens": 1}


def test_no_documents(spark, docs, tmp_path):
    manifest = token_files.write_tokens(docs([]), str(tmp_path), WORDS, 2)
    assert token_files.read_tokens(spark, str(tmp_path), manifest).count() == 0
