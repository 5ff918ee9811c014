"""The normalisation of records in one Arrow pass: what text.prepare says, with what a word becomes looked up once a word.

text.prepare is a chain of expressions that each read the whole text again. Here a text is read a few times, and steps
that need a pattern are tried only where a cheap sign of it is there.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import lexicon as L
from .text import DOUBLE, FIRST_LETTER, LAST_LETTER, SINGLE, SOUNDS

OTHER = re.compile(f"[^\0-{chr(FIRST_LETTER - 1)}]")
URL, URL_SIGN = re.compile(L.URL, re.ASCII), re.compile(r"\.(?:com|net|org|biz|info|co|in|fr|us|io)")
DOTTED, DOTTED_SIGN = re.compile(r"\b(?:[a-z]\.){2,}", re.ASCII), re.compile(r"\.[a-z]\.")
FOREIGN = re.compile(r"[^\0-\x7f]+")
#: Bytes to themselves where they are letters or digits, else to a space.
SPACED = bytes(p if chr(p).isascii() and chr(p).isalnum() else 32 for p in range(256))
PINS = re.compile(r"\b(\d{3})\s(\d{3})\b", re.ASCII)
ORDINAL, ZEROS, NUMBER = re.compile(r"(\d+)(?:st|nd|rd|th)", re.ASCII), re.compile(r"\A0+(\d)", re.ASCII), re.compile(r"\d+", re.ASCII)
AREAS = re.compile(r"\b(?:" + "|".join(sorted(L.FRENCH_AREAS, key=len, reverse=True)) + r")\b", re.ASCII)
AREA_STARTS = frozenset(a.split()[0] for a in L.FRENCH_AREAS)
STATES = [(n, re.compile(rf"\b{n}\b", re.ASCII), L.STATES[n]) for n in sorted(L.STATES, key=len, reverse=True)]
STATE_STARTS = frozenset(n.split()[0] for n in L.STATES)
DROPPED, FILLERS = frozenset([*L.LEGAL, *L.GENERIC, *L.STOP]), frozenset(L.ADDRESS_FILLERS)
LEET = str.maketrans(L.LEET_DIGITS, L.LEET_LETTERS)
#: Words that a cache holds at most, and the length of the longest that it keeps.
MOST, LONGEST = 250_000, 64
MADE = {"country_key": "string", "name_nonlatin": "boolean", "name_n": "string", "name_core": "string", "addr_n": "string", "nums": "array<string>", "postal": "array<string>"}


class Kept(dict):
    """word -> make(word), bounded: emptied when full, long words are made anew each time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[word] = value
        return value


class _Plain(dict):
    """Code point -> its plain letters."""

    def __missing__(self, p: int) -> str:
        c = chr(p)
        value = " " if c in "°º" or p > LAST_LETTER else SOUNDS[c] if p >= FIRST_LETTER else DOUBLE.get(c) or SINGLE.get(c, c)
        self[p] = value
        return value


PLAIN = _Plain()


def other_script(s: str) -> bool:
    return not s.isascii() and OTHER.search(s) is not None


def plain_words(s: str) -> list[str]:
    """S1-S7 of a text: its words of a-z and 0-9."""
    s = (s if s.isascii() else FOREIGN.sub(lambda m: m[0].translate(PLAIN), s)).lower().replace("'", "").replace("`", "")
    if URL_SIGN.search(s):
        s = URL.sub(r" \1 ", s)
    if DOTTED_SIGN.search(s):
        s = DOTTED.sub(lambda m: m[0].replace(".", ""), s)
    return s.replace("&", " and ").encode("ascii", "replace").translate(SPACED).decode().split()


def _name_word(t: str) -> str:
    """S9, S8."""
    digits = sum(c.isdigit() for c in t)
    if digits and len(t) - digits >= 2 and 2 * digits <= len(t):
        t = t.translate(LEET)
    return L.NAME_ABBREVIATIONS.get(t, t)


def _bare(t: str) -> str:
    """S15, of one word."""
    m = ORDINAL.fullmatch(t)
    return ZEROS.sub(r"\1", m[1] if m else t) if t[0] == "0" or m else t


def _short(t: str) -> str:
    """S18, of one word: empty if it is a filler."""
    return "" if t in FILLERS else L.ADDRESS_FORMS.get(t, t)


def same_script(s: str) -> str:
    """S13."""
    if not other_script(s):
        return s
    ws = [w.decode("utf-8", "surrogatepass") for w in s.encode("utf-8", "surrogatepass").split()]
    left = [w for w in ws if not other_script(w)]
    return " ".join(left) if 2 * (len(ws) - len(left)) < len(ws) else s


UNVOICED, REPEATED = str.maketrans("", "", L.VOWELS), re.compile(r"(.)\1+")


def sound_key(w: str) -> str:
    """S25."""
    for a, b in L.SOUNDS:
        w = w.replace(a, b)
    return REPEATED.sub(r"\1", w.translate(UNVOICED))


class Normalizer:
    """Names and addresses to their normal forms; holds the caches of a task."""

    def __init__(self):
        self.name_words, self.bare = Kept(_name_word), Kept(_bare)
        self.short = Kept(_short)
        self.both = Kept(lambda t: _short(_bare(t)))

    def name(self, s: str) -> str:
        return " ".join(map(self.name_words.__getitem__, plain_words(s)))

    def core(self, name: str, country: str) -> str:
        own = country.split(" ")
        left = [t for t in name.split(" ") if t and t not in DROPPED and t not in own]
        return " ".join(left) if left else name

    def address(self, s: str) -> str:
        ws = plain_words(same_script(s))
        s = " ".join(ws)
        if PINS.search(s):
            ws = PINS.sub(r"\1\2", s).split(" ")
        areas, states = not AREA_STARTS.isdisjoint(ws), not STATE_STARTS.isdisjoint(ws)
        if not areas and not states:  # their words have no digits, so words with and without them can be told before
            return " ".join(filter(None, map(self.both.__getitem__, ws)))
        s = " ".join([self.bare[t] for t in ws])
        s = AREAS.sub(" ", s) if areas and any(a in s for a in L.FRENCH_AREAS) else s
        for name, pattern, code in STATES if states else ():
            if name in s:
                s = pattern.sub(code, s)
        return " ".join(filter(None, map(self.short.__getitem__, s.split())))

    def columns(self, names: list, addresses: list, countries: list) -> list[pa.Array]:
        """The columns MADE of records."""
        keys = [(c or "").strip(" ").lower() for c in countries]
        name = [self.name(s or "") for s in names]
        address = [self.address(s or "") for s in addresses]
        nums = [sorted(set(NUMBER.findall(a))) for a in address]
        made = (keys, [other_script(s or "") for s in names], name, list(map(self.core, name, keys)), address, nums, [[n for n in x if len(n) in (5, 6)] for x in nums])
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        return [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]


def first_words(texts: list, n: int) -> tuple[list[str], list[str]]:
    """The first n words of texts, and all others, as records.text_records has them."""
    ws = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    return tuple([b" ".join(w[part]).decode("utf-8", "surrogatepass") for w in ws] for part in (slice(n), slice(n, None)))


def prepare(records: DataFrame, text: str | None = None, name_words: int = 8) -> DataFrame:
    """S23, as text.prepare: normalised columns beside those of records (entity_id, business_name, business_address, country).

    With `text`, a column of whole texts stands for name and address (see records.text_records), and none of the three is returned.
    """
    kept = [c for c in records.columns if c not in MADE and c != text]

    def run(batches):
        normal = Normalizer()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                columns = lambda *names, part=part: [part.column(c).to_pylist() for c in names]
                both = first_words(*columns(text), name_words) if text else columns("business_name", "business_address")
                made = normal.columns(*both, *columns("country"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *MADE])

    own = [f"`{c}` {t}" for c, t in records.dtypes if c in kept]
    source = records.select(*kept, *([text] if text else []))
    return source.mapInArrow(run, ", ".join([*own, *(f"{c} {t}" for c, t in MADE.items())]))
