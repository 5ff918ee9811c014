"""Quality classifier by weak labels (operator 5).

Overlapping heuristic labellers vote good, bad or abstain on every whole document. Their votes are counted by pattern
over the whole corpus (3 ** LABELLERS patterns at most, whatever its size); expectation-maximisation on the counts
estimates each labeller's rates under good and bad documents and gives every pattern a posterior. The posteriors of a
bounded sample train a linear scorer on hashed word shapes, and that scorer judges all documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED, cut, lean, slices

#: Documents whose posteriors train the scorer, hash buckets of its features, rounds of its training and of the estimation.
TRAIN, BUCKETS, ROUNDS, EM_ROUNDS = 6000, 1 << 12, 200, 60
#: A document goes only if the scorer gives it less than this: when in doubt, it stays.
KEEP = 0.3
#: Words at which a document's features have half their weight; words of a stretch in which distinct ones are counted.
FEW, STRETCH = 8, 1000
#: Pull of the scorer's weights to zero.
SHRINK = 1e-6
#: Frequent function words (fixed list): English, German, French, Spanish.
STOPS = frozenset(
    "the of and to in is that it was for on with as be by this are der die und das den von zu mit sich des auf für ist im dem nicht ein eine le la les de des et en un une du que pour dans est el los y las del se por con una".encode().split()
)
#: Bytes that end sentences, that ordinary text has besides letters and digits, and letters by case.
ORDINARY = np.zeros(256, dtype=bool)
ORDINARY[[*b" \n\t\r.,;:'\"?!()-", *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: name: (a share, the share from which it votes bad, the share up to which it votes good); a low share is bad where bad < good.
LABELLERS = {
    "symbols": (0.03, 0.01),
    "marked_words": (0.2, 0.02),
    "exclamations": (0.2, 0.05),
    "capitals": (0.5, 0.2),
    "repeats": (0.15, 0.05),
    "distinct": (0.2, 0.4),
    "stops": (0.02, 0.08),
    "sentences": (0.002, 0.02),
}
SHAPES = [(re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"9")]


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters and digits as X, x and 9; other characters as they are, runs of one shortened to two."""
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return re.sub(rb"(.)\1\1+", rb"\1\1", word)


class Words(dict):
    """word -> 64 bits: hash of the word, below it the bucket of its shape (12 bits), a stop word (1) and a trailing symbol (1).

    Long words are not kept, so memory is bounded.
    """

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        flags = (word.lower() in STOPS) << 1 | (not ORDINARY[word[-1]])
        value = h >> 14 << 14 | xxhash.xxh3_64_intdigest(shape(word)) % BUCKETS << 2 | flags
        if len(word) <= CACHED:
            if len(self) >= 300_000:
                self.clear()
            self[word] = value
        return value


def distinct(words: np.ndarray) -> float:
    """Share of distinct words in stretches of equal length, the mean over a text, so that it doesn't fall with the text's length."""
    n = len(words)
    if n <= STRETCH:
        return len(np.unique(words)) / n
    rows = np.sort(words[: n - n % STRETCH].reshape(-1, STRETCH), axis=1)
    counts = (1 + (rows[:, 1:] != rows[:, :-1]).sum(1)).tolist()
    if n % STRETCH:
        counts.append(len(np.unique(words[-STRETCH:])))
    return sum(counts) / len(counts) / STRETCH


def shares(raw: bytes, words: np.ndarray) -> dict[str, float]:
    """What the labellers look at, of a document with words."""
    n, seen = len(words), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, letters = seen[65:91].sum(), seen[65:91].sum() + seen[97:123].sum() + seen[0xC3:].sum()
    ident = words >> np.uint64(14)
    return {
        "symbols": seen[~ORDINARY].sum() / max(1, seen.sum()),
        "marked_words": float((words & np.uint64(1)).sum()) / n,
        "exclamations": seen[33] / n,
        "capitals": upper / max(1, letters) if letters >= 10 else 0.3,
        "repeats": float((ident[1:] == ident[:-1]).sum()) / max(1, n - 1),
        "distinct": distinct(ident) if n >= 40 else 0.3,
        "stops": float((words >> np.uint64(1) & np.uint64(1)).sum()) / n if n >= 20 else 0.05,
        "sentences": (seen[46] + seen[63]) / n if n >= 20 else 0.01,
    }


def votes(found: dict[str, float]) -> list[int]:
    """1 good, 0 bad, 2 abstain, by labeller."""
    out = []
    for name, (bad, good) in LABELLERS.items():
        x = found[name] if bad > good else -found[name]
        bad, good = (bad, good) if bad > good else (-bad, -good)
        out.append(0 if x >= bad else 1 if x <= good else 2)
    return out


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: roots of the shares that word shapes and pairs of neighbouring shapes, repeats apart, have."""
    s = (words >> np.uint64(2) & np.uint64(BUCKETS - 1)).astype(np.int64)
    same = (words[1:] >> np.uint64(14)) == (words[:-1] >> np.uint64(14))
    pairs = (s[:-1] * 31 + s[1:] * 17 + same * 1009 + 7) % BUCKETS
    b, n = np.unique(np.concatenate([s, pairs]), return_counts=True)
    return b, np.sqrt(n / n.sum()) * len(words) / (len(words) + FEW)  # a few words are little evidence


def documents(batches, columns: tuple[str, ...], cache: Words | None = None):
    """Batches of columns and _text -> (other values, bytes, word integers) a document."""
    cache = Words() if cache is None else cache
    for values in slices(batches, (*columns, "_text"), "_text", 1_000_000):
        for *rest, text in zip(*values, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            w = raw.split()
            yield rest, raw, np.fromiter(map(cache.__getitem__, w), dtype=np.uint64, count=len(w))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, rates[class, labeller, vote] and the prior of good, by expectation-maximisation.

    Starts from the majority of votes, which also says which class is good. Counts are smoothed by one vote each.
    """
    for_it, against = (patterns == 1).sum(1), (patterns == 0).sum(1)
    post = np.clip((for_it + 1) / (for_it + against + 2), 0.05, 0.95)
    onehot = np.eye(3)[patterns]
    rates, prior = None, 0.5
    for _ in range(EM_ROUNDS):
        weight = np.stack([(1 - post) * counts, post * counts])
        rates = np.einsum("cp,plv->clv", weight, onehot) + 1
        rates /= rates.sum(2, keepdims=True)
        prior = float(np.clip(weight[1].sum() / max(1e-9, weight.sum()), 0.01, 0.99))
        like = np.einsum("plv,clv->cp", onehot, np.log(rates)) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
    return post, rates, prior


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by full-batch gradients with per-weight rates."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    squares, square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * value, len(rows)) + bias, -50, 50)))
        error = (p - y) / len(rows)
        g = np.bincount(at, value * error[row], BUCKETS) + SHRINK * w
        squares += g * g
        square += error.sum() ** 2
        w -= 0.3 * g / np.sqrt(squares)
        bias -= 0.3 * error.sum() / square**0.5
    return w, bias


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer. Votes of all rows enter the estimates; at most train_rows documents train it.

    These are the first by hash among distinct (key, text) with a key, so repeated rows train once. The driver holds
    pattern counts (3 ** LABELLERS at most) and that sample's features, both bounded.
    """
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    zero = "".join("2" for _ in LABELLERS)

    def voted(raw, words):
        return "".join(map(str, votes(shares(raw, words)))) if len(words) else zero

    def vote(batches):
        seen: dict[str, int] = {}
        for _, raw, words in documents(batches, ()):
            v = voted(raw, words)
            seen[v] = seen.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    counted = source.select("_text").mapInArrow(lean(vote), "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([[int(c) for c in r["votes"]] for r in counted] or [[2] * len(LABELLERS)])
    posterior, _, prior = estimate(patterns, np.array([r["n"] for r in counted] or [0], dtype=float))
    post = {r["votes"]: float(p) for r, p in zip(counted, posterior, strict=False)}

    def featured(batches):
        for (row,), raw, words in documents(batches, ("_row",)):
            if len(words):
                b, w = features(words)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([voted(raw, words)]), pa.array([b.astype(np.int32)], pa.list_(pa.int32())), pa.array([w.astype(np.float32)], pa.list_(pa.float32()))], names=["row", "votes", "b", "w"])

    row = F.xxhash64("_key", "_h")
    chosen = cut(source.where(F.col("_key").isNotNull()).select("_key", "_h").distinct().orderBy(row, "_key", "_h").limit(train_rows))
    sample = source.join(F.broadcast(chosen), ["_key", "_h"], "left_semi").select(row.alias("_row"), "_text").mapInArrow(lean(featured), "row long, votes string, b array<int>, w array<float>")
    sample = sample.groupBy("row").agg(F.first(F.struct("votes", "b", "w")).alias("x")).select("x.*").toArrow()  # train_rows rows at most
    rows = [(b.values.to_numpy(), w.values.to_numpy().astype(np.float64), post.get(v.as_py(), prior)) for v, b, w in zip(sample["votes"], sample["b"], sample["w"], strict=True)]
    return train(sorted(rows, key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes())))


def scores(texts: pa.Array, weights: np.ndarray, bias: float, cache: Words) -> np.ndarray:
    """Scores of a column of texts; 0 without words."""
    out = []
    for _, _, words in documents([pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["_text"])], (), cache):
        b, w = features(words) if len(words) else ([], [])
        out.append(1 / (1 + np.exp(-np.clip(weights[b] @ w + bias, -50, 50))) if len(words) else 0.0)
    return np.array(out)


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN) -> DataFrame:
    """key, score (of the linear scorer, between 0 and 1, rounded), kept (score >= KEEP), for each row of docs.

    Null and empty texts and texts without words have score 0 and are not kept. Whole texts of any length are judged;
    repeated rows repeat their result, rows of a null key are judged like others but don't train the scorer. Keys may
    have any type that can be grouped. Other columns are not read, so their names can't clash. An empty table gives none.
    """
    weights, bias = fit(docs, key, text, train_rows)
    kind = dict(docs.dtypes)[key]

    def judge(batches):
        cache = Words()
        for batch in batches:
            score = scores(batch.column("_text"), weights, bias, cache)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(np.round(score, 4), pa.float64()), pa.array(score >= KEEP, pa.bool_())], names=[key, "score", "kept"])

    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(lean(judge), f"`{key}` {kind}, score double, kept boolean")


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN) -> DataFrame:
    """The rows of docs that the classifier keeps (see classify), with all columns; rows are judged where they are read."""
    weights, bias = fit(docs, key, text, train_rows)

    def judge(batches):
        cache = Words()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text), weights, bias, cache) >= KEEP, pa.bool_()))

    return docs.mapInArrow(lean(judge), docs.schema)
