"""PII surrogates (operator 2), in DataFrame functions only.

Detected entities get replacements derived from a secret key: the same entity the same one everywhere (whatever its
letter case), of the same type, script and format; persons keep their title, and given names their gender. Surrogates
are checked over the whole corpus: where two entities would share one, or one would equal a real entity, the later
entity draws again, so distinct entities stay distinct. Only the entities of the corpus are shuffled for that, never
texts; the few that drew again reach their documents through a join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut
from .common import let as _let

#: Titles by gender (fixed list); x is either.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"], "x": ["Dr", "Prof"]}
#: Given names by gender (fixed list). A name becomes the next one of its list, in an order that the key decides.
GIVEN = {
    "m": "James John Robert Michael William David Thomas Charles Daniel Matthew Hans Klaus Jürgen Stefan Pierre Jean Luc Antoine Carlos José Juan Miguel Pedro Diego Иван Сергей Алексей Дмитрий".split(),
    "f": "Mary Patricia Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Anna Ursula Sabine Petra Marie Claire Sophie Camille María Carmen Lucía Elena Isabel Sofía Ольга Наталья Елена Анна".split(),
}
#: Patterns of the entities; the first that fits says the type.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = r"\p{Lu}[\p{L}'’-]+"
LOCAL = r"[\p{L}\p{N}._%+-]"
#: What a title or a given name starts with; looked at first, it spares most positions the list of names.
INITIALS = "".join(sorted({n[0] for ns in (*TITLES.values(), *GIVEN.values()) for n in ns}))
NAMED = "|".join(n for ns in GIVEN.values() for n in ns)
TITLED = "|".join(t for ts in TITLES.values() for t in ts)
PATTERNS = {
    # tried only where a local part, or what a match has left of it, begins, and never again within it; lengths are those
    # that addresses may have at most: a repeated group takes the matcher's stack at each turn, so it has to be bounded
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}{{1,64}}+" r"@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?=[{INITIALS}])(?<!\p{{L}})(?:(?:{TITLED})\.? {WORD}(?: {WORD}){{0,2}}|(?:{NAMED}) {WORD})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text has to hold for any of the patterns to fit: an at sign, four digits close together, or a title or given name.
MAYBE = rf"@|[0-9](?:[^\p{{L}}\n]{{0,3}}[0-9]){{3}}|(?=[{INITIALS}])(?<!\p{{L}})(?:{TITLED}|{NAMED})[. ]|[A-Z]{{2}}[0-9]{{2}}"
#: Alphabets within which characters are replaced: equal script and case.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
VOWELS, CONSONANTS = "aeiou", "bdfgklmnprstv"
#: Draws after which a surrogate may leave its entity's format, so that drawing ends even where a format has too few values.
STRICT = 8


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


#: All alphabets in a row, and for each of their characters where its alphabet begins and how long it is.
CHARACTERS = "".join(ALPHABETS)
BEGINS = [CHARACTERS.index(a) for a in ALPHABETS for _ in a]
LENGTHS = [len(a) for a in ALPHABETS for _ in a]


def _swap(c: Column, draw: Column) -> Column:
    """A character of the same alphabet, by a drawn number; characters of no alphabet stay."""

    def other(p: Column) -> Column:
        at = F.get(F.lit(BEGINS), p - 1) + F.pmod(draw, F.get(F.lit(LENGTHS), p - 1)) + 1
        return F.when(p == 0, c).otherwise(F.substring(F.lit(CHARACTERS), at.cast("int"), F.lit(1)))

    return _let(F.position(c, F.lit(CHARACTERS)), other)


def _drawn(text: Column, seed: Column) -> Column:
    """text with every letter and digit drawn anew."""
    return F.array_join(F.transform(_chars(text), lambda c, i: _swap(c, F.xxhash64(seed, i))), "")


def _spoken(word: Column, seed: Column) -> Column:
    """A name: Latin letters as consonants and vowels in turn, in the word's length and case; other scripts as _drawn."""

    def letter(c: Column, i: Column) -> Column:
        n = F.xxhash64(seed, i)
        small = F.when(i % 2 == 0, F.substring(F.lit(CONSONANTS), (F.pmod(n, F.lit(len(CONSONANTS))) + 1).cast("int"), F.lit(1))).otherwise(F.substring(F.lit(VOWELS), (F.pmod(n, F.lit(len(VOWELS))) + 1).cast("int"), F.lit(1)))
        return F.when(c.rlike("[a-zà-öø-ÿß]"), small).when(c.rlike("[A-ZÀ-ÖØ-Þ]"), F.upper(small)).otherwise(_swap(c, n))

    return F.array_join(F.transform(_chars(word), letter), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, mod 10."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), value), F.lit(0), lambda a, b: a + b) % 10


def kind_of(entity: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in PATTERNS.items():
        # lookarounds see only the entity here, and at its ends they hold
        out = out.when(entity.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("other")


def surrogate(kind: Column, entity: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity (an email, a number or one word of a name) at a draw; letter case follows the entity."""
    salt = hashlib.sha256(key.encode()).hexdigest()
    return _let(F.struct(kind.alias("kind"), entity.alias("entity"), draw.alias("draw")), lambda x: _surrogate(x["kind"], x["entity"], x["draw"], salt))


def _surrogate(kind: Column, entity: Column, draw: Column, salt: str) -> Column:
    seed = lambda *of: F.sha2(F.concat_ws("\0", F.lit(salt), *of), 256)
    longer = lambda c="0": F.repeat(F.lit(c), F.greatest(draw - STRICT + 1, F.lit(0)))

    def email(own: Column) -> Column:
        local, domain, top = (F.regexp_extract(entity, "^([^@]+)@(.*)(\\.[^.]+)$", i) for i in (1, 2, 3))
        return F.concat(_drawn(F.concat(local, longer()), own), F.lit("@"), _let(domain, lambda d: _drawn(d, seed(F.lit("domain"), F.lower(d)))), top)

    def ip(own: Column) -> Column:
        def octet(o: Column, i: Column) -> Column:
            # as many digits as before: 1-9, 10-99 or 100-255
            low = F.when(draw >= STRICT, 1).when(F.length(o) == 1, 1).when(F.length(o) == 2, 10).otherwise(100)
            many = F.when(draw >= STRICT, 254).when(F.length(o) == 1, 9).when(F.length(o) == 2, 90).otherwise(156)
            return (F.pmod(F.xxhash64(own, i), many) + low).cast("string")

        return F.array_join(F.transform(F.split(entity, "\\."), octet), ".")

    def number(own: Column) -> Column:
        def checked(n: Column) -> Column:
            """A card that passes the Luhn check stays one that does."""
            valid = (kind == "card") & (_let(F.regexp_replace(entity, "[^0-9]", ""), _luhn) == 0)
            body = F.substring(n, F.lit(1), F.length(n) - 1)
            last = F.pmod(-_let(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0")), _luhn), F.lit(10)).cast("string")
            return F.when(valid, F.concat(body, last)).otherwise(n)

        return _let(_drawn(F.concat(entity, longer()), own), checked)

    def coded(own: Column) -> Column:
        """The country code of a phone and of an account stay."""
        head = F.when(kind == "iban", F.substring(entity, F.lit(1), F.lit(2))).when(entity.rlike("^\\+|\\("), F.regexp_extract(entity, "^\\+?[0-9]{1,3}(?=[ .(-])", 0)).otherwise("")
        return _let(head, lambda h: F.concat(h, _drawn(F.concat(F.substring(entity, F.length(h) + 1, F.length(entity)), longer()), own)))

    def any_kind(own: Column) -> Column:
        out = F.when(kind == "email", email(own)).when(kind == "ip", ip(own)).when(kind.isin("phone", "iban"), coded(own))
        return out.when(kind == "name", _spoken(F.concat(entity, longer("o")), own)).otherwise(number(own))

    return _let(seed(kind, F.lower(entity), draw.cast("string")), any_kind)


def _given(word: Column, key: str) -> Column:
    """The surrogate of a listed given name, else null: a rotation of each gender's (and script's) list, so distinct names stay distinct."""
    pairs: list[Column] = []
    for names in GIVEN.values():
        for script in (lambda n: n[0] < "Ѐ", lambda n: n[0] >= "Ѐ"):
            ring = sorted(filter(script, names), key=lambda n: hashlib.sha256(f"{key}\0{n}".encode()).digest())
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                pairs += [F.lit(a), F.lit(b)]
    return F.element_at(F.create_map(*pairs), word)


TITLE = "^(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?$"


def entities(match: Column) -> Column:
    """The (kind, entity) items of a detected span: the span itself, or of a person the words that are neither title nor given name."""
    words = F.filter(F.split(match, " "), lambda w: ~w.rlike(TITLE) & _given(w, "").isNull())
    item = lambda kind, e: F.struct(kind.alias("kind"), F.lower(e).alias("norm"))
    return _let(kind_of(match), lambda k: F.when(k == "person", F.transform(words, lambda w: item(F.lit("name"), w))).otherwise(F.array(item(k, match))))


def draws(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, draw) of the entities that can't have their first surrogate; found has kind and norm.

    Of entities that share a surrogate the least keeps it, and none may take what is a real entity or is taken.
    Each round handles only what is still open; rounds end because later draws leave the format.
    """
    real = cut(found.select("kind", "norm").distinct())
    drawn = lambda df, n: df.withColumn("made", F.lower(surrogate(F.col("kind"), F.col("norm"), F.lit(n), key)))
    names = real.select("kind", F.col("norm").alias("made"))
    settled, out, n = None, None, 0
    todo = real
    while True:
        made = drawn(todo, n)
        first = made.groupBy("kind", "made").agg(F.min("norm").alias("norm"))
        free = first.join(names, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "made"], "left_anti")
        free = cut(free.select("kind", "norm", "made"))
        todo = cut(todo.select("kind", "norm").join(free, ["kind", "norm"], "left_anti"))
        if n:
            some = free.select("kind", "norm", F.lit(n).alias("draw"))
            out = some if out is None else out.union(some)
        settled = free.select("kind", "made") if settled is None else settled.union(free.select("kind", "made"))
        n += 1
        if not todo.limit(1).count():
            break
    return out if out is not None else real.select("kind", "norm", F.lit(0).alias("draw")).where("false")


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the entities of every whole text replaced by surrogates, and n_entities (long).

    Null texts stay null with 0 entities; texts without entities stay as they are. Repeated rows are treated alike.
    All columns of docs are returned, the text changed in place; a column n_entities of docs is replaced, and names that
    start with _pii_ are reserved.
    """
    hit = F.coalesce(F.col(text).rlike(MAYBE) & F.col(text).rlike(ANY), F.lit(False))
    every = lambda: F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    row = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = cut(docs.where(hit).select(row.alias("_pii_row"), F.explode(F.flatten(F.transform(every(), entities))).alias("e")).select("_pii_row", "e.kind", "e.norm").distinct())
    again = cut(draws(found, secret))
    later = found.join(again, ["kind", "norm"]).groupBy("_pii_row").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\0", "kind", "norm"), "draw"))).alias("_pii_draws"))
    later = cut(later)
    few = later.agg(F.coalesce(F.sum(F.size("_pii_draws")), F.lit(0))).first()[0] <= BROADCAST_IDS
    df = docs.withColumn("_pii_hit", hit).withColumn("_pii_row", F.when(F.col("_pii_hit"), row).otherwise(F.concat(F.lit("none "), row)))
    df = df.join(F.broadcast(later) if few else later.hint("merge"), "_pii_row", "left")
    df = df.withColumn("_pii_m", F.when(F.col("_pii_hit"), every())).withColumn("_pii_p", F.when(F.col("_pii_hit"), F.split(text, ANY, -1)))

    def word(w: Column, kind: Column) -> Column:
        """A word of a person, or another kind's whole span, replaced."""
        draw = F.coalesce(F.element_at("_pii_draws", F.concat_ws("\0", kind, F.lower(w))), F.lit(0))
        made = surrogate(kind, w, draw, secret)
        return F.when((kind == "name") & w.rlike(TITLE), w).otherwise(F.coalesce(F.when(kind == "name", _given(w, secret)), made))

    def replaced(m: Column) -> Column:
        def by_kind(k: Column) -> Column:
            parts = F.when(k == "person", F.split(m, " ")).otherwise(F.array(m))
            return F.array_join(F.transform(parts, lambda w: word(w, F.when(k == "person", "name").otherwise(k))), " ")

        return _let(kind_of(m), by_kind)

    df = df.withColumn("_pii_m", F.transform("_pii_m", replaced))
    whole = F.concat(F.array_join(F.zip_with(F.slice("_pii_p", F.lit(1), F.size("_pii_m")), "_pii_m", lambda p, m: F.concat(p, m)), ""), F.element_at("_pii_p", -1))
    df = df.withColumn("n_entities", F.when(F.col("_pii_hit"), F.size("_pii_m").cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_pii_text", F.when(F.col("_pii_hit"), whole).otherwise(F.col(text)))
    return df.select(*[F.col("_pii_text").alias(text) if c == text else F.col(c) for c in docs.columns if c != "n_entities"], "n_entities")
