"""Benchmark decontamination by q-gram lemma filtering (operator 1).

A benchmark item of m characters that occurs in a document with at most k edits leaves at least m + 1 - (k + 1) q of
its q-grams in place, on diagonals (document position minus item position) no further than k apart. So: look up the
q-grams of every whole text, count hits in overlapping bands of diagonals, keep the bands that reach the bound, and
verify the region they point at by an alignment confined to the band.

Where q-grams repeat (rules of dashes, one word over and over), a text and an item share a hit for every pair of their
positions. Such texts are taken one by one: what is counted there are the positions of the text whose q-gram the item
has at all, within windows as long as the item and its edits, which the same bound holds for; neighbouring windows are
one region of wide bands. Long texts are searched in windows that overlap by more than any item's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, lean, slices

#: Length of q-grams, edits allowed as a share of an item's characters.
Q, RATE = 8, 0.1
#: Characters of benchmark text in one block. A block is what a task holds; more blocks take more passes over the documents.
BLOCK_CHARS = 8_000_000
#: Characters of documents looked up at a time, hits (pairs of equal q-grams) written out for them, characters of a region aligned at a time.
STEP, HITS, REGION = 400_000, 1_000_000, 1 << 15


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed in an item of m characters: the rate, but no more than leave it a q-gram to be found by."""
    return max(0, min(int(rate * m), (m + 1) // q - 1 - ((m + 1) % q == 0)))


def folded(text: str) -> np.ndarray:
    """One byte per character. Equal characters have equal bytes; a collision only lets a region through to verification."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return (c ^ (c >> 8) * 37 ^ (c >> 16) * 11).astype(np.uint8)


def qgrams(chars: np.ndarray) -> np.ndarray:
    """The q-gram at each position as a 64-bit integer (Q is its number of bytes)."""
    n = len(chars) - Q + 1
    out = np.empty(max(n, 0), dtype=np.uint64)
    for i in range(min(Q, max(n, 0))):
        part = chars[i : i + (n - i - 1) // Q * Q + Q]
        out[i::Q] = part.view(np.uint8)[: len(out[i::Q]) * Q].copy().view("<u8")
    return out


def alignment(item: str, region: str, edits: int, low: int, high: int) -> tuple[int, int] | None:
    """(edits, end in region) of the item against any part of the region, if at most `edits`.

    Only cells whose diagonal (region position minus item position) lies in low..high are filled.
    """
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in (item, region))
    width, far = high - low + 1, len(a) + len(b) + 1
    diagonal = np.arange(low, high + 1)
    row = np.where((diagonal >= 0) & (diagonal <= len(b)), 0, far)  # row i holds cells (i, i + diagonal)
    steps = np.arange(width)
    padded = np.concatenate([np.zeros(max(0, -low) + 1, np.uint32), b, np.zeros(max(0, len(a) + high - len(b)) + 1, np.uint32)])
    shift = max(0, -low) + 1
    for i in range(1, len(a) + 1):
        at = i + diagonal
        differs = padded[i - 1 + low + shift : i + high + shift] != a[i - 1]
        inside = (at >= 1) & (at <= len(b))
        cost = np.where(inside, row + differs, far)
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        cost = np.where((at >= 0) & (at <= len(b)), cost, far)
        row = np.minimum.accumulate(cost - steps) + steps  # gaps in the item run along the row
        row = np.where((at >= 0) & (at <= len(b)), row, far)
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return int(row[best]), len(a) + low + best


class Index:
    """The q-grams of a block of items, sorted, behind a table of the hash values that occur. Items are (id, normalised text)."""

    BITS = 22

    def __init__(self, items: list[tuple[object, str]], rate: float):
        owners: dict[str, list[int]] = {}  # equal texts are searched once
        for at, (_, t) in enumerate(items):
            if t:
                owners.setdefault(t, []).append(at)
        ids: dict[object, int] = {}  # the first item of each id stands for all of them
        first = [ids.setdefault(i, at) for at, (i, _) in enumerate(items)]
        self.texts = list(owners)
        self.owners = [sorted({first[at] for at in x}) for x in owners.values()]
        self.edits = np.array([budget(len(t), rate) for t in self.texts], dtype=np.int64)
        self.least = np.array([len(t) + 1 - (k + 1) * Q for t, k in zip(self.texts, self.edits.tolist(), strict=True)], dtype=np.int64)
        self.reach = max((len(t) + k for t, k in zip(self.texts, self.edits.tolist(), strict=True)), default=0)
        grams = [qgrams(folded(t)) for t in self.texts]
        keys = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(g), dtype=np.int32) for g in grams]])[order]
        self.seen = np.zeros(1 << self.BITS, dtype=bool)
        self.seen[self.slot(self.keys)] = True
        self.short = None
        for i, t in enumerate(self.texts):
            if len(t) < Q:
                import ahocorasick

                self.short = self.short or ahocorasick.Automaton()
                self.short.add_word(t, i)
        if self.short:
            self.short.make_automaton()

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry and number of entries of each q-gram."""
        first = np.searchsorted(self.keys, keys, "left")
        return first, np.searchsorted(self.keys, keys, "right") - first

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, place of the item in the block, start, end, edits): the best occurrence of each item in each text, in normalised characters."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held: list[tuple[int, int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for at in self.windows(len(text)) if len(self.keys) else ():
                held.append((k, at, text[at : at + max(STEP, 2 * self.reach)]))
                size += len(held[-1][2])
                if size >= STEP:
                    self._search(held, best)
                    held, size = [], 0
            if self.short:
                self._short(k, text, best)
        if held:
            self._search(held, best)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (k, i), (d, s, e) in best.items():
            for owner in self.owners[i]:
                out[k, owner] = min(out.get((k, owner), (d, s, e)), (d, s, e))
        return [(k, i, s, e, d) for (k, i), (d, s, e) in sorted(out.items())]

    def windows(self, n: int) -> range:
        """Where the windows of a text of n characters begin; any stretch of `reach` characters lies whole in one."""
        size = max(STEP, 2 * self.reach)
        return range(0, max(1, n - self.reach), size - self.reach)

    def _short(self, k: int, text: str, best) -> None:
        """Items shorter than a q-gram, where they stand as whole words."""
        for last, i in self.short.iter(text):
            s, e = last + 1 - len(self.texts[i]), last + 1
            joined = (s and text[s - 1].isalnum() and text[s].isalnum()) or (e < len(text) and text[last].isalnum() and text[e].isalnum())
            if not joined and (k, i) not in best:
                best[k, i] = (0, s, e)

    def _search(self, pieces: list[tuple[int, int, str]], best) -> None:
        """Best occurrences in pieces (text, offset, characters) of texts."""
        chars = [folded(t) for _, _, t in pieces]
        begin = np.cumsum([0, *[len(c) + 1 for c in chars]])
        joined = np.zeros(begin[-1], dtype=np.uint8)  # pieces with a zero byte between
        for b, c in zip(begin, chars, strict=False):
            joined[b : b + len(c)] = c
        keys = qgrams(joined)
        at = np.flatnonzero(self.seen[self.slot(keys)])
        first, n = self.entries(keys[at])
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        if n.sum() > HITS:
            half = len(pieces) // 2
            if half:
                self._search(pieces[:half], best)
                self._search(pieces[half:], best)
            else:
                self._dense(pieces[0], keys[at], at, best)
            return
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        piece = np.searchsorted(begin, at, side="right") - 1
        if len(at):
            self._regions(pieces, piece, at - begin[piece], self.item[entry].astype(np.int64), self.at[entry].astype(np.int64), best)

    def _regions(self, pieces, piece, at, item, pos, best) -> None:
        # a band can't reach the bound where a text and an item share too few q-grams altogether
        _, pair, shared = np.unique(piece * len(self.texts) + item, return_inverse=True, return_counts=True)
        enough = shared[pair] >= self.least[item]
        piece, at, item, pos = piece[enough], at[enough], item[enough], pos[enough]
        if not len(at):
            return
        diagonal = at - pos
        half = self.edits[item] + 1  # bands of 2 (k + 1) diagonals, half overlapping: any k + 1 neighbouring ones lie in one
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            # within a band, one item position counts once however often the text repeats it
            key = np.stack([piece, item, band, pos])
            order = np.lexsort(key[::-1])
            key = key[:, order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (key[:3, 1:] != key[:3, :-1]).any(0)
            distinct = new.copy()
            distinct[1:] |= key[3, 1:] != key[3, :-1]
            starts = np.flatnonzero(new)
            count = np.add.reduceat(distinct.astype(np.int64), starts)
            reach = starts[count >= self.least[key[1, starts]]]
            for s in reach.tolist():
                p, i, b = (int(x) for x in key[:3, s])
                k = int(self.edits[i])
                low = b * 2 * (k + 1) - shift * (k + 1) - k
                self._verify(pieces[p], i, max(0, low), low + 2 * (k + 1) - 1 + 2 * k + len(self.texts[i]), low, low + 2 * (k + 1) - 1 + 2 * k, best)

    def _verify(self, piece, i: int, left: int, right: int, low: int, high: int, best) -> None:
        """Item i in the characters left..right of a piece, alignments confined to the diagonals low..high of the piece."""
        text, offset, chars = piece
        k, wanted = int(self.edits[i]), self.texts[i]
        if best.get((text, i), (k + 1,))[0] == 0:
            return
        region = chars[left : max(0, right)]
        if (x := region.find(wanted)) >= 0:
            d, end = 0, x + len(wanted)
        else:
            done = alignment(wanted, region, k, low - left, high - left)
            if done is None or done[0] > k:
                return
            d, end = done
        end += offset + left
        found = (d, max(0, end - len(wanted)), end)
        best[text, i] = min(best.get((text, i), found), found)

    def _dense(self, piece, keys: np.ndarray, at: np.ndarray, best) -> None:
        """A piece with too many hits to write out; keys are the q-grams that items have, at their positions."""
        grams, which = np.unique(keys, return_inverse=True)
        by = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[by], np.arange(len(grams) + 1))
        first, n = self.entries(grams)
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        gram, item = np.repeat(np.arange(len(grams)), n), self.item[entry]
        # an item that has too few positions whose q-gram occurs here at all is not here
        there = np.bincount(item, minlength=len(self.texts)) >= self.least
        gram, item = gram[there[item]], item[there[item]]
        order = np.argsort(item, kind="stable")
        gram, item = gram[order], item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else np.zeros(1, np.int64)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            i = int(item[a])
            k, m = int(self.edits[i]), len(self.texts[i])
            where = np.sort(np.concatenate([at[by[bounds[g] : bounds[g + 1]]] for g in np.unique(gram[a:b]).tolist()]))
            within = np.searchsorted(where, where + (m + k - Q), "right") - np.arange(len(where))
            good = where[within >= self.least[i]]  # where the first hit of an occurrence may be
            if not len(good):
                continue
            cuts = np.flatnonzero(np.diff(good) > 2 * (m + k)) + 1
            for part in np.split(good, cuts):
                left, right = max(0, int(part[0]) - m - k), int(part[-1]) + m + k
                step = max(REGION, 4 * (m + k))
                for x in range(left, max(left + 1, right - m - k), step - m - k):
                    end = min(right, x + step, len(piece[2]))
                    self._verify(piece, i, x, end, x - k, end, best)


def _blocks(benchmark: DataFrame, item: str, text: str, chars: int):
    """The benchmark in blocks of bounded size, read row by row."""
    block, size = [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        block.append((r["i"], normal(r["t"])))
        size += len(block[-1][1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, item_id, start, end, edits: the benchmark items that occur in each whole text within the edit budget.

    Positions are those of the normalised text (lower case, single spaces); start is exact for exact occurrences, else
    the end minus the item's length. Null and empty texts and items match nothing; items shorter than a q-gram are
    found where they stand as whole words; repeated rows repeat their result, items of one id and several texts count
    under that id. Ids may have any type; rows of a null key are searched like others, items of a null id are not.
    Other columns are not read, so their names can't clash. Texts of any length and repetition are searched in bounded
    memory. The benchmark is a query set against all documents, in blocks of block_chars: each block is sent to the
    tasks and the documents are read once per block. Nothing is shuffled.
    """
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    schema = f"`{key}` {kinds[0]}, item_id {kinds[1]}, start bigint, end bigint, edits bigint"
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    item_type = to_arrow_type(benchmark.schema[item].dataType)

    def searcher(block):
        def run(batches):
            index, ids = Index(block, rate), pa.array([i for i, _ in block], item_type)
            for batch in batches:
                if rows := _rows(index, batch.column("_text")):
                    col = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("_key").take(col[0]), ids.take(col[1]), *col[2:]], names=[key, "item_id", "start", "end", "edits"])

        return run

    out = None
    for block in _blocks(benchmark, item, item_text, block_chars):
        made = source.mapInArrow(lean(searcher(block)), schema)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _rows(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """Matches in a column of texts, each with its row."""
    at, rows = 0, []
    for (some,) in slices([pa.RecordBatch.from_arrays([texts], names=["t"])], ("t",), "t", STEP):
        rows += [(at + k, *r) for k, *r in index.matches([normal(t) for t in some])]
        at += len(some)
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows in which a benchmark item occurs, all columns as they are.

    Rows are judged where they are read, so ids don't matter: null ones, repeated ones, ones of any type. Null and empty
    texts stay. What is left after one block of the benchmark is written before the next, as a task holds one block.
    """
    spark_text = docs.columns.index(text)

    def filter_(block):
        def run(batches):
            index = Index(block, rate)
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                keep[[r[0] for r in _rows(index, batch.column(spark_text).cast(pa.string()))]] = False
                yield batch.filter(pa.array(keep))

        return run

    out, blocks = docs, 0
    for block in _blocks(benchmark, item, item_text, block_chars):
        out = (cut(out) if blocks else out).mapInArrow(lean(filter_(block)), docs.schema)
        blocks += 1
    return out
