"""Normalisation of names and addresses as Column builders. The order of steps is part of the contract."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L

#: Latin letters beyond these are another script's.
LAST_LATIN = 0x24F
#: Letters whose plain form isn't their decomposition's first letter.
SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŋ": "ng", "Ŋ": "NG"}


def latin_table() -> dict[str, str]:
    """Accented letter -> plain letters, U+00C0 to U+024F, by decomposition."""
    out = {}
    for c in map(chr, range(0xC0, LAST_LATIN + 1)):
        plain = SPECIAL.get(c) or unicodedata.normalize("NFKD", c)[0]
        if plain != c and plain.isascii():
            out[c] = plain
    return out


SINGLE = {c: p for c, p in latin_table().items() if len(p) == 1}
DOUBLE = {c: p for c, p in latin_table().items() if len(p) > 1}
#: Letters of other scripts that their names don't say the sound of: Cyrillic names, and Greek ones that stand for two letters.
CYRILLIC = {"ie": "e", "ghe": "g", "yeru": "y", "sign": "", "io": "yo"}
GREEK = {"theta": "th", "phi": "ph", "chi": "ch", "psi": "ps"}


def _sound_of(c: str) -> str:
    """A character of another script in Latin letters, by its Unicode name: consonants without the vowel that only names them."""
    name = unicodedata.name(c, "")
    last = name.split(" WITH ")[0].split()[-1:] or [""]
    word = last[0].lower()
    if "VIRAMA" in name or unicodedata.category(c) in ("Mn", "Mc") and "VOWEL SIGN" not in name:
        return ""
    if "DIGIT" in name and unicodedata.decimal(c, None) is not None:
        return str(unicodedata.decimal(c))
    if "LETTER" not in name and "VOWEL SIGN" not in name:
        return " "
    if name.startswith("CYRILLIC"):
        word = CYRILLIC.get(word, word)
        if len(word) > 1 and word[0] != "y":  # be, em, sha: b, m, sh
            word = word.strip("aeiou") or word
    elif name.startswith("GREEK"):
        word = GREEK.get(word, word[:1])
    elif name.startswith(("ARABIC", "HEBREW")):
        word = re.match("[^aeiou]*", word)[0] or word[:1]
    elif "LETTER" in name and len(word) > 1 and word.endswith("a"):
        word = word[:-1]
    return "".join(x for i, x in enumerate(word) if not i or x != word[i - 1] or x not in "dtln")


class _Sounds(dict):
    """Character -> Latin letters, each looked up once; there are no more characters than Unicode has."""

    def __missing__(self, c: str) -> str:
        value = self[c] = c if c.isascii() else LATIN.get(c) or _sound_of(c)
        return value


LATIN = latin_table()
SOUNDS = _Sounds()


def transliterate_text(text: str) -> str:
    """Any script to lower-case Latin letters."""
    return "".join(map(SOUNDS.__getitem__, text)).lower()


#: Code points of scripts with letters: what comes after Latin Extended-B up to Thai. Other characters sound like nothing.
FIRST_LETTER, LAST_LETTER = LAST_LATIN + 1, 0xE7F
SPELLINGS = "\1".join(SOUNDS[chr(p)] for p in range(FIRST_LETTER, LAST_LETTER + 1))


def spelled(s: Column) -> Column:
    """Letters of other scripts in Latin ones, by one array that is looked into at the code point."""
    table = F.split(F.lit(SPELLINGS), "\1")  # folded into a constant

    def sound(c: Column) -> Column:
        p = F.ascii(c)
        return F.when(p < FIRST_LETTER, c).when(p <= LAST_LETTER, F.get(table, p - FIRST_LETTER)).otherwise(" ")

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), sound), "")


def latin(s: Column) -> Column:
    """Accented Latin letters to plain ones, JVM-side."""
    for a, b in DOUBLE.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, "".join(SINGLE), "".join(SINGLE.values()))


def plain(s: Column) -> Column:
    """Degree and ordinal signs to spaces, any letters of any script to lower-case ASCII; nothing leaves the JVM."""
    s = F.regexp_replace(s, "[°º]", " ")
    made = latin(s)
    return F.lower(F.when(has_other_script(s), spelled(made)).otherwise(made))


def has_other_script(s: Column) -> Column:
    """Some character lies beyond Latin Extended-B (typographic quotes and dashes count)."""
    return F.coalesce(s.rlike(r"[^\x{0000}-\x{024F}]"), F.lit(False))


def collapse_urls(s: Column) -> Column:
    return F.regexp_replace(s, L.URL, " $1 ")


def letters_and_digits(s: Column) -> Column:
    """S6."""
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean(s: Column) -> Column:
    """All of S1-S6, of any script; null is empty."""
    s = F.translate(plain(F.coalesce(s, F.lit(""))), "'`", "")
    return letters_and_digits(join_dotted(collapse_urls(s)))


def join_dotted(s: Column) -> Column:
    """Dots leave runs of two and more single letters with dots; texts without a run, nearly all, are only looked at."""
    run = r"\b(?:[a-z]\.){2,}"
    parts, runs = F.split(s, run, -1), F.regexp_extract_all(s, F.lit(run), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.replace(F.get(runs, i), F.lit("."), F.lit("")), F.lit("")))), "")
    return F.when(s.rlike(run), joined).otherwise(s)


def words(s: Column) -> Column:
    """Words between single spaces; none for the empty string."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def map_words(s: Column, table: dict[str, str]) -> Column:
    """S8."""
    m = _lookup(table)
    return F.array_join(F.transform(words(s), lambda t: F.coalesce(F.element_at(m, t), t)), " ")


def unleet(t: Column) -> Column:
    """S9, of one word: digits in disguise where a word has two letters and no more digits than letters."""
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    letters = F.length(t) - digits
    return F.when((digits > 0) & (letters >= 2) & (digits <= letters), F.translate(t, L.LEET_DIGITS, L.LEET_LETTERS)).otherwise(t)


def norm_name(s: Column) -> Column:
    """S10."""
    return map_words(F.array_join(F.transform(words(clean(s)), unleet), " "), L.NAME_ABBREVIATIONS)


def core_name(name: Column, country: Column) -> Column:
    """Without legal, generic and stop words and the record's own country; the whole name if nothing is left."""
    drop = F.array(*map(F.lit, [*L.LEGAL, *L.GENERIC, *L.STOP]))
    left = F.filter(words(name), lambda t: ~F.array_contains(drop, t) & ~F.array_contains(words(country), t))
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(name)


def drop_mixed_script(s: Column) -> Column:
    """Words of another script go if there are some, but fewer than half."""
    ws = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    other = F.size(F.filter(ws, has_other_script))
    return F.when((other > 0) & (other * 2 < F.size(ws)), F.array_join(F.filter(ws, lambda t: ~has_other_script(t)), " ")).otherwise(s)


def join_pins(s: Column) -> Column:
    return F.regexp_replace(s, r"\b(\d{3})\s(\d{3})\b", "$1$2")


def bare_numbers(s: Column) -> Column:
    """Ordinal endings, then leading zeros."""
    return F.regexp_replace(F.regexp_replace(s, r"\b(\d+)(?:st|nd|rd|th)\b", "$1"), r"\b0+(\d)", "$1")


def drop_areas(s: Column) -> Column:
    areas = "|".join(sorted(L.FRENCH_AREAS, key=len, reverse=True))
    return F.regexp_replace(s, rf"\b(?:{areas})\b", " ")


def code_states(s: Column) -> Column:
    """Longest names first."""
    names = sorted(L.STATES, key=len, reverse=True)
    out = s
    for n in names:
        out = F.regexp_replace(out, rf"\b{n}\b", L.STATES[n])
    return F.when(s.rlike(r"\b(?:" + "|".join(names) + r")\b"), out).otherwise(s)


def short_address_words(s: Column, keep_states: bool = False) -> Column:
    """Fillers go, then words take their short form. A state code that is also a filler goes with them, unless keep_states."""
    fillers = [w for w in L.ADDRESS_FILLERS if not (keep_states and w in L.STATES.values())]
    drop, forms = F.array(*map(F.lit, fillers)), _lookup(L.ADDRESS_FORMS)
    return F.array_join(F.transform(F.filter(words(F.trim(F.regexp_replace(s, r"\s+", " "))), lambda t: ~F.array_contains(drop, t)), lambda t: F.coalesce(F.element_at(forms, t), t)), " ")


def norm_address(s: Column) -> Column:
    """S19."""
    s = join_pins(clean(drop_mixed_script(F.coalesce(s, F.lit("")))))
    return short_address_words(code_states(drop_areas(bare_numbers(s))))


def country_key(s: Column) -> Column:
    return F.lower(F.trim(F.coalesce(s, F.lit(""))))


def numbers(address: Column) -> Column:
    """S21."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(address, F.lit(r"\d+"), F.lit(0))))


def postal(nums: Column) -> Column:
    return F.filter(nums, lambda n: F.length(n).isin(5, 6))


def bare_number(t: Column) -> Column:
    """090 -> 90, 000 -> 0."""
    return F.coalesce(F.nullif(F.regexp_replace(t, "^0+", ""), F.lit("")), F.lit("0"))


def is_number(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def sound_key(w: Column) -> Column:
    """The consonants of a word, alike-sounding ones merged, repeats collapsed."""
    for a, b in L.SOUNDS:
        w = F.replace(w, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(w, L.VOWELS, ""), r"(.)\1+", "$1")


def informative(s: Column) -> Column:
    """Words of three letters and more that aren't numbers."""
    return F.filter(words(s), lambda t: (F.length(t) >= 3) & ~is_number(t))


def record_text(name: Column, address: Column, country: Column) -> Column:
    """S26."""
    return F.concat_ws(" ; ", F.coalesce(name, F.lit("")), F.coalesce(address, F.lit("")), F.coalesce(country, F.lit("")))


def corrupt(text: Column, seed: Column) -> Column:
    """One corruption decided by a digest of seed and text: drop a word, swap two letters, or swap two words."""
    ws = words(text)
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(" "), text)), 7 * i + 1, 7), 16, 10).cast("int")
    n = F.size(ws)
    at = drawn(0) % F.greatest(n, F.lit(1)) + 1
    dropped = F.array_join(F.filter(ws, lambda w, i: i + 1 != at), " ")
    next_ = F.when(at < n, at + 1).otherwise(F.lit(1))
    swapped = F.array_join(F.transform(ws, lambda w, i: F.when(i + 1 == at, F.get(ws, next_ - 1)).when(i + 1 == next_, F.get(ws, at - 1)).otherwise(w)), " ")
    p = drawn(1) % F.greatest(F.length(text) - 1, F.lit(1)) + 1
    letters = F.concat(F.substring(text, F.lit(1), p - 1), F.substring(text, p + 1, F.lit(1)), F.substring(text, p, F.lit(1)), F.substring(text, p + 2, F.length(text)))
    kind = drawn(2) % 3
    return F.when(n < 2, text).when(kind == 0, dropped).when(kind == 1, letters).otherwise(swapped)


def prepare(records: DataFrame) -> DataFrame:
    """Normalised columns beside entity_id, business_name, business_address, country.

    The steps of S10 and S19, one column after another: a column that a step uses more than once is computed once.
    """
    first = lambda s: collapse_urls(F.translate(plain(F.coalesce(s, F.lit(""))), "'`", ""))
    df = records.withColumns({"country_key": country_key(F.col("country")), "name_nonlatin": has_other_script(F.col("business_name")), "_n": first(F.col("business_name")), "_a": F.coalesce("business_address", F.lit(""))})
    df = df.withColumns({"_n": join_dotted(F.col("_n")), "_a": first(drop_mixed_script(F.col("_a")))})
    df = df.withColumns({"_n": letters_and_digits(F.col("_n")), "_a": join_dotted(F.col("_a"))})
    df = df.withColumns({"_n": F.array_join(F.transform(words(F.col("_n")), unleet), " "), "_a": drop_areas(bare_numbers(join_pins(letters_and_digits(F.col("_a")))))})
    df = df.withColumns({"name_n": map_words(F.col("_n"), L.NAME_ABBREVIATIONS), "_a": code_states(F.col("_a"))})
    df = df.withColumns({"name_core": core_name(F.col("name_n"), F.col("country_key")), "addr_n": short_address_words(F.col("_a"))})
    df = df.withColumn("nums", numbers(F.col("addr_n"))).drop("_n", "_a")
    return df.withColumn("postal", postal(F.col("nums")))
