"""Token generators for blocking (T1-T5): arrays of distinct tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bare_number, is_number, sound_key, words


def pairs_of(a: Column, joiner: str = "_") -> Column:
    """Adjacent pairs of an array; none for fewer than two items."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), lambda x, y: F.concat(x, F.lit(joiner), y))


def crossed(a: Column, b: Column, joiner: str = "#", most: int = 4) -> Column:
    """The first items of a with the first items of b."""
    return F.flatten(F.transform(F.slice(a, 1, most), lambda x: F.transform(F.slice(b, 1, most), lambda y: F.concat(x, F.lit(joiner), y))))


def address_numbers(address: Column) -> Column:
    return F.transform(F.filter(words(address), is_number), bare_number)


def unigrams(name: Column, core: Column, address: Column) -> Column:
    """Words of the core name, core and full name glued, # and number, address words of three letters and more."""
    glued = F.array(F.replace(core, F.lit(" "), F.lit("")), F.replace(name, F.lit(" "), F.lit("")))
    nums = F.transform(address_numbers(address), lambda t: F.concat(F.lit("#"), t))
    rest = F.filter(words(address), lambda t: ~is_number(t) & (F.length(t) >= 3))
    return F.array_distinct(F.filter(F.concat(words(core), glued, nums, rest), lambda t: t != ""))


def combos(core: Column, address: Column) -> Column:
    """Neighbours in core and address, and core words with address numbers."""
    a = F.transform(words(address), lambda t: F.when(is_number(t), bare_number(t)).otherwise(t))
    return F.array_distinct(F.concat(pairs_of(words(core)), pairs_of(a), crossed(words(core), address_numbers(address))))


def sounds(core: Column, address: Column) -> Column:
    """Sound keys, neighbours among them, and keys with address numbers; numbers and empty keys go first."""
    keys = F.filter(F.transform(F.filter(words(core), lambda t: ~is_number(t)), sound_key), lambda k: k != "")
    marked = F.transform(keys, lambda k: F.concat(F.lit("~"), k))
    alone = F.filter(marked, lambda k: F.length(k) >= 3)
    return F.array_distinct(F.concat(alone, F.transform(pairs_of(keys), lambda p: F.concat(F.lit("~"), p)), crossed(marked, address_numbers(address))))


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def characters(core: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """T4: character n-grams within words padded by a space on each side; a word shorter than n counts once, whole."""

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        each = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), _cut(padded, n)) for n in sizes]
        return F.concat(*each)

    return F.array_distinct(F.flatten(F.transform(words(core), grams)))


#: T5: retrievers by name.
RETRIEVERS = {
    "uni": lambda n, c, a: unigrams(n, c, a),
    "combo": lambda n, c, a: F.array_union(unigrams(n, c, a), combos(c, a)),
    "combo_ph": lambda n, c, a: F.array_union(F.array_union(unigrams(n, c, a), combos(c, a)), sounds(c, a)),
    "chars": lambda n, c, a: characters(c),
    "name_words": lambda n, c, a: F.array_distinct(words(c)),
    "addr_words": lambda n, c, a: F.array_distinct(words(a)),
}
