"""Secret scan with corpus-wide ownership frequency (operator 4), in DataFrame functions only.

Spans of three base kinds are found in every whole text. Beyond them, long mixed tokens are candidates too. All
candidate values are hashed and counted over the corpus by distinct repository and owner: a value that several owners
have, or that goes through many repositories of few owners, is a widely copied example; one that stays with one or two
owners and a few repositories looks live. Mixed tokens that look live are added to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def any_case(word: str) -> str:
    """The pattern of a word in either case, ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
#: kind: (pattern, least length, group that the length is of), in the order in which kinds are listed.
BASE = {
    "assign": ("(" + "|".join(map(any_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": ("AKIA[A-Z0-9]+", 20, 0),
    "hex": ("[0-9a-f]{24,}", 24, 0),
}
#: The method's own candidates: 20 and more characters with at least one digit, one upper-case and one lower-case letter.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
#: A value that so many owners have, or so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Spans are summed up in blocks of so many, which keeps a text with n of them at about n * BLOCK steps.
BLOCK = 64


def located(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Adds column `out`: array of (start, end, value) of the leftmost non-overlapping matches, in code points; value is the group's text."""
    n = F.size("_m")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    df = df.withColumn("_hit", F.col(text).rlike(pattern))
    none = F.lit(None).cast("array<string>")
    df = df.withColumn("_m", F.when(F.col("_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_g", F.when(F.col("_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none))
    df = df.withColumn("_p", F.when(F.col("_hit"), F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.lit(None).cast("array<int>")))
    df = df.withColumn("_step", F.transform("_m", lambda m, i: F.length(m) + F.get("_p", i)))
    df = df.withColumn("_blocks", F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice("_step", b * BLOCK + 1, F.lit(BLOCK)))))

    def span(m: Column, i: Column) -> Column:
        block = (i / BLOCK).cast("int")
        before = total(F.slice("_blocks", F.lit(1), block)) + total(F.slice("_step", block * BLOCK + 1, i % BLOCK))
        start = before + F.get("_p", i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.get("_g", i).alias("value"))

    spans = F.transform("_m", span)
    empty = F.lit(None).cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(out, F.coalesce(F.when(F.col("_hit"), spans).otherwise(empty), F.array().cast("array<struct<start:int,end:int,value:string>>"))).drop("_hit", "_m", "_g", "_p", "_step", "_blocks")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _at_least(n: int):
    return lambda s: F.length(s["value"]) >= n


def _tagged(kind: str, order: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(s["value"], 256).alias("hash"))


def scan(docs: DataFrame, text: str = "text", repository: str = "lang", owner: str = "source", key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_spans, base_sha256, spans, n_live, n_example, n_owners, n_repositories: one row per row of docs.

    n_owners and n_repositories are those of the document's most widespread candidate (0 without candidates). Null and
    empty texts have no spans. A repository counts within its owner; a null repository or owner is a value of its own.
    Repeated rows each get a row and count once; rows of a null key are scanned like others. Other columns are not
    read, so their names can't clash. Texts never leave the scan: what is shuffled are candidate hashes, first reduced
    to one per (value, owner, repository) and task. A value that a large share of documents has is not shuffled to one task.
    """
    kinds = [*BASE, "mixed"]
    df = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"), F.coalesce(F.col(repository).cast("string"), F.lit("\0")).alias("_repo"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("_owner"))
    for kind, (pattern, least, group) in BASE.items():
        df = located(df, "_t", pattern, kind, group)
        df = df.withColumn(kind, F.filter(kind, _at_least(least)))
    df = located(df, "_t", MIXED, "mixed")
    df = df.withColumn("mixed", F.filter("mixed", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")))
    tagged = [
        F.transform(kind, _tagged(kind, i))
        for i, kind in enumerate(kinds)
    ]
    df = df.withColumn("_base", F.array_sort(F.concat(*tagged[:-1])))
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("_all", F.concat("_base", F.filter(tagged[-1], apart)))
    found = cut(
        df.select(
            key,
            "_repo",
            "_owner",
            *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
            "_base",
            "_all",
            F.sha2(F.concat_ws("\0", F.col(key).cast("string"), "_t"), 256).alias("_row"),
        )
    )
    some = found.where(F.size("_all") > 0)
    seen = some.select(F.explode("_all").alias("s"), "_owner", "_repo").groupBy(F.col("s.hash").alias("hash"), "_owner", "_repo").agg(F.count("*").alias("n"))
    owners = seen.groupBy("hash", "_owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    owners = cut(owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n")))
    unique = cut(some.groupBy("_row").agg(F.first("_all").alias("_all"), F.count("*").alias("copies")))
    ruled = join_counted(unique.select("_row", "copies", F.explode("_all").alias("s")).select("_row", "copies", "s.*"), owners, "hash")
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)
    rows = ruled.groupBy("_row").agg(
        F.first("copies").alias("copies"),
        F.array_sort(F.collect_list(F.when(live & (F.col("kind") == "mixed"), F.struct("start", "order", "end", "kind", "hash")))).alias("_more"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live).cast("long")).alias("n_example"),
        F.max("owners").alias("n_owners"),
        F.max("repositories").alias("n_repositories"),
    )
    rows = cut(rows)
    none = F.array().cast(rows.schema["_more"].dataType)
    zero = F.lit(0).cast("long")
    with_some = join_counted(some, rows, "_row", "copies").withColumn("_spans", F.array_sort(F.concat("_base", "_more")))
    without = found.where(F.size("_all") == 0).select("*", none.alias("_spans"), *[zero.alias(c) for c in ("n_live", "n_example", "n_owners", "n_repositories")])
    columns = [
        key,
        *[f"n_{k}" for k in BASE],
        _joined(F.col("_base")).alias("base_spans"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        "n_live",
        "n_example",
        "n_owners",
        "n_repositories",
    ]
    return with_some.select(*columns).unionByName(without.select(*columns))


def _duck_spans(kind: str, order: int, pattern: str, least: int, group: int, more: str = "") -> str:
    q = pattern.replace("'", "''")
    return f"""
{kind}_m AS (
  SELECT rid, regexp_extract_all(t, '{q}') AS m, regexp_extract_all(t, '{q}', {group}) AS g, string_split_regex(t, '{q}') AS p FROM d
  WHERE regexp_matches(t, '{q}')),
{kind}_s AS (
  SELECT rid, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i FROM {kind}_m),
{kind} AS (
  SELECT rid, '{kind}' AS kind, {order} AS ord, s + length(p) AS b, s + length(p) + length(m) AS e, g AS value FROM (
    SELECT *, coalesce(sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM {kind}_s)
  WHERE length(g) >= {least}{more})"""


def oracle() -> str:
    """DuckDB SQL for scan(documents)."""
    parts = [_duck_spans(k, i, p, n, g) for i, (k, (p, n, g)) in enumerate(BASE.items())]
    parts.append(_duck_spans("mixed", 3, MIXED, 20, 0, " AND regexp_matches(g, '[0-9]') AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]')"))
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, chr(0)) AS repo, coalesce(source, chr(0)) AS owner FROM documents),"
        + ",".join(parts)
        + f""",
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = m.rid AND x.b < m.e AND m.b < x.e)),
own AS (SELECT value, count(DISTINCT owner) AS n, count(DISTINCT owner || chr(10) || repo) AS r FROM cand JOIN d USING (rid) GROUP BY value),
ruled AS (SELECT c.*, n, r, n < {EXAMPLE_OWNERS} AND r < {EXAMPLE_REPOSITORIES} AS live FROM cand c JOIN own o USING (value)),
agg AS (SELECT rid, sum((kind = 'assign')::BIGINT)::BIGINT AS n_assign, sum((kind = 'access')::BIGINT)::BIGINT AS n_access, sum((kind = 'hex')::BIGINT)::BIGINT AS n_hex,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (WHERE kind <> 'mixed'), '') AS base_spans,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (WHERE kind <> 'mixed' OR live), '') AS spans,
  sum(live::BIGINT)::BIGINT AS n_live, sum((NOT live)::BIGINT)::BIGINT AS n_example, max(n) AS n_owners, max(r) AS n_repositories FROM ruled GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_spans, '') AS base_spans, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_owners, 0) AS n_owners, coalesce(n_repositories, 0) AS n_repositories
FROM d LEFT JOIN agg USING (rid)"""
    )
