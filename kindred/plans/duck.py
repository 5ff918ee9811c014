"""DuckDB SQL of the normalisers, tokens and blocking: an independent statement of the same contracts."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.text import DOUBLE, SINGLE
from ..sources.records import FIRST_SOURCES, NAME_WORDS, THIRD_SOURCES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def texts(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda t: t <> '')"


def join(e: str, by: str = " ") -> str:
    return f"array_to_string({e}, {q(by)})"


def sub(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, 'g')"


def table(d: dict[str, str]) -> str:
    return f"map({texts(d)}, {texts(d.values())})"


def plain(e: str) -> str:
    e = sub(e, "[°º]", " ")
    for a, b in DOUBLE.items():
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"lower(translate({e}, {q(''.join(SINGLE))}, {q(''.join(SINGLE.values()))}))"


def bare(e: str) -> str:
    """Plain letters without apostrophes and backticks, URLs collapsed."""
    return sub(f"translate({plain(e)}, {q(chr(39) + '`')}, '')", L.URL, " \\1 ")


def undotted(e: str) -> str:
    run = q(r"\b(?:[a-z]\.){2,}")
    p, m = f"string_split_regex({e}, {run})", f"regexp_extract_all({e}, {run})"
    return f"array_to_string(list_transform(range(1, len({p}) + 1), lambda i: ({p})[i] || coalesce(replace(({m})[i], '.', ''), '')), '')"


def other_script(e: str) -> str:
    return f"regexp_matches({e}, '[^\\x{{0000}}-\\x{{024F}}]')"


def letters(e: str) -> str:
    return f"trim({sub(sub(f'''replace({e}, '&', ' and ')''', '[^a-z0-9 \\t\\n\\f\\r]', ' '), '[ \\t\\n\\f\\r]+', ' ')})"


def unleet(t: str) -> str:
    d = f"(length({t}) - length(translate({t}, '0123456789', '')))"
    return f"CASE WHEN {d} > 0 AND length({t}) - {d} >= 2 AND {d} * 2 <= length({t}) THEN translate({t}, '{L.LEET_DIGITS}', '{L.LEET_LETTERS}') ELSE {t} END"


def number(t: str) -> str:
    return f"coalesce(nullif(ltrim({t}, '0'), ''), '0')"


def is_number(t: str) -> str:
    return f"regexp_full_match({t}, '[0-9]+')"


def sound_key(w: str) -> str:
    for a, b in L.SOUNDS:
        w = f"replace({w}, {q(a)}, {q(b)})"
    w = f"translate({w}, '{L.VOWELS}', '')"
    for c in "bcdfghjklmnpqrstvwxz0123456789":
        w = f"regexp_replace({w}, '{c}+', '{c}', 'g')"
    return w


def _states(e: str) -> str:
    for n in sorted(L.STATES, key=len, reverse=True):
        e = sub(e, rf"\b{n}\b", L.STATES[n])
    return e


AREAS = "|".join(sorted(L.FRENCH_AREAS, key=len, reverse=True))
DROP = texts([*L.LEGAL, *L.GENERIC, *L.STOP])
#: documents as records, then normalised step by step.
RECORDS = f"""
r0 AS (SELECT doc_id AS entity_id, lang, source, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w FROM documents),
rec AS (SELECT entity_id, array_to_string(w[1:{NAME_WORDS}], ' ') AS business_name, array_to_string(w[{NAME_WORDS + 1}:], ' ') AS business_address, lang AS country,
  CASE WHEN source IN ({", ".join(map(q, FIRST_SOURCES))}) THEN 1 ELSE 2 END AS side, coalesce(source IN ({", ".join(map(q, THIRD_SOURCES))}), false) AS is_s3 FROM r0)"""
PREPARED = (
    RECORDS
    + f""",
c1 AS (SELECT *, {other_script("business_name")} AS name_nonlatin, lower(trim(coalesce(country, ''))) AS country_key,
  {bare("business_name")} AS n1, {bare("business_address")} AS a1 FROM rec),
c2 AS (SELECT *, {undotted("n1")} AS n2, CASE WHEN regexp_matches(a1, '\\b(?:[a-z]\\.){{2,}}') THEN {undotted("a1")} ELSE a1 END AS a2 FROM c1),
c3 AS (SELECT *, {letters("n2")} AS n3, {letters("a2")} AS a3 FROM c2),
c4 AS (SELECT *, {join(f"list_transform(list_transform({words('n3')}, lambda t: {unleet('t')}), lambda t: coalesce({table(L.NAME_ABBREVIATIONS)}[t], t))")} AS name_n,
  {sub(sub(sub(sub("a3", r"\b([0-9]{3})\s([0-9]{3})\b", "\\1\\2"), r"\b([0-9]+)(?:st|nd|rd|th)\b", "\\1"), r"\b0+([0-9])", "\\1"), rf"\b(?:{AREAS})\b", " ")} AS a4 FROM c3),
c5 AS (SELECT *, list_filter({words("name_n")}, lambda t: NOT list_contains({DROP}, t) AND NOT list_contains({words("country_key")}, t)) AS left_n,
  CASE WHEN regexp_matches(a4, {q(chr(92) + "b(?:" + "|".join(sorted(L.STATES, key=len, reverse=True)) + ")" + chr(92) + "b")}) THEN {_states("a4")} ELSE a4 END AS a5 FROM c4),
c6 AS (SELECT *, CASE WHEN len(left_n) > 0 THEN array_to_string(left_n, ' ') ELSE name_n END AS name_core,
  {join(f"list_transform(list_filter({words(sub('a5', '[ ]+', ' '))}, lambda t: NOT list_contains({texts(L.ADDRESS_FILLERS)}, t)), lambda t: coalesce({table(L.ADDRESS_FORMS)}[t], t))")} AS addr_n FROM c5),
prep AS (SELECT entity_id, business_name, business_address, country, country_key, side, is_s3, name_nonlatin, name_n, name_core, addr_n, list_sort(list_distinct(regexp_extract_all(addr_n, '[0-9]+'))) AS nums FROM c6)"""
)


def neighbours(a: str, mark: str = "") -> str:
    return f"list_transform(range(1, greatest(len({a}), 1)), lambda i: {q(mark)} || ({a})[i] || '_' || ({a})[i + 1])"


def crossed(a: str, b: str, mark: str = "") -> str:
    return f"flatten(list_transform(({a})[1:4], lambda x: list_transform(({b})[1:4], lambda y: {q(mark)} || x || '#' || y)))"


def tokens(retriever: str) -> str:
    """`tok` (entity_id, country_key, side, token) over `prep`."""
    uni = "list_filter(list_concat(cw, [replace(name_core, ' ', ''), replace(name_n, ' ', '')], list_transform(nw, lambda t: '#' || t), list_filter(aw, lambda t: NOT " + is_number("t") + " AND length(t) >= 3)), lambda t: t <> '')"
    combo = f"list_concat({neighbours('cw')}, {neighbours('an')}, {crossed('cw', 'nw')})"
    sound = f"list_concat(list_transform(list_filter(sk, lambda k: length(k) >= 2), lambda k: '~' || k), {neighbours('sk', '~')}, {crossed('sk', 'nw', '~')})"
    chars = "flatten(list_transform(cw, lambda w: list_concat(" + ", ".join(f"list_transform(range(1, greatest(length(w) + 2 - {n} + 1, 1) + 1), lambda i: substr(' ' || w || ' ', i::INT, {n}))" for n in (3, 4)) + ")))"
    made = {"uni": uni, "combo": f"list_concat({uni}, {combo})", "combo_ph": f"list_concat({uni}, {combo}, {sound})", "combos": combo, "sounds": sound, "chars": chars, "name_words": "cw", "addr_words": "aw"}[retriever]
    return f"""
k1 AS (SELECT *, {words("name_core")} AS cw, {words("addr_n")} AS aw FROM prep),
k2 AS (SELECT *, list_transform(list_filter(aw, lambda t: {is_number("t")}), lambda t: {number("t")}) AS nw, list_transform(aw, lambda t: CASE WHEN {is_number("t")} THEN {number("t")} ELSE t END) AS an,
  list_filter(list_transform(list_filter(cw, lambda t: NOT {is_number("t")}), lambda t: {sound_key("t")}), lambda k: k <> '') AS sk FROM k1),
lists AS (SELECT entity_id, country_key, side, list_distinct({made}) AS tokens FROM k2),
tok AS (SELECT entity_id, country_key, side, unnest(tokens) AS token FROM lists)"""


def weighted(least_df: int, max_df: int | None, tok: str = "tok", name: str = "wt") -> str:
    """`wt` (tok with df, n, idf, w)."""
    gate = f"BETWEEN {least_df} AND {max_df}" if max_df else f">= {least_df}"
    return f"""
{name}_df AS (SELECT country_key, token, count(*) AS df FROM {tok} GROUP BY ALL HAVING count(*) {gate}),
{name}_n AS (SELECT country_key, count(*) AS n FROM prep GROUP BY country_key),
{name}_i AS (SELECT t.*, df, n, ln((n + 1) / (df + 1)) + 1 AS idf FROM {tok} t JOIN {name}_df USING (country_key, token) JOIN {name}_n USING (country_key)),
{name} AS (SELECT *, idf / sqrt(sum(idf * idf) OVER (PARTITION BY entity_id)) AS w FROM {name}_i)"""


SCORES = """
scores AS (SELECT a.country_key, a.entity_id AS s1_id, b.entity_id AS cand_id, sum(a.w * b.w) AS score FROM wt a JOIN wt b ON a.country_key = b.country_key AND a.token = b.token AND a.side = 1 AND b.side = 2 GROUP BY ALL HAVING sum(a.w * b.w) > 1e-9),
ranks AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 6) DESC, cand_id) - 1 AS fwd, row_number() OVER (PARTITION BY cand_id ORDER BY round(score, 6) DESC, s1_id) - 1 AS rev FROM scores)"""
TRUTH = f"""
own AS (SELECT lang, md5(text) AS h, min(doc_id) AS s1 FROM documents WHERE source IN ({", ".join(map(q, FIRST_SOURCES))}) GROUP BY ALL),
truth AS (SELECT s1, doc_id AS m FROM documents d JOIN own ON d.lang = own.lang AND md5(d.text) = own.h WHERE NOT source IN ({", ".join(map(q, FIRST_SOURCES))}))"""


def candidates(k_forward: int = 20, k_reverse: int = 3) -> str:
    return f"""
cand AS (SELECT country_key, s1_id, cand_id, score, least(fwd, {k_forward})::INT AS fwd_rank, least(rev, {k_reverse})::INT AS rev_rank FROM ranks WHERE fwd < {k_forward} OR rev < {k_reverse})"""
