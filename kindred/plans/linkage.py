"""Queries over documents as business records: normalisation, tokens, blocking, recall, profiles; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as K
from ..operators import blocking as B
from ..sources import records as R
from ..sources.session import table
from . import duck as D
from .registry import query

#: Document frequencies that the gate lets through (fixed values).
LEAST_DF, MAX_DF = 2, 5000


def digest(items: Column) -> Column:
    return F.md5(F.array_join(F.sort_array(items), " "))


DOTTED = D.q(r"\b(?:[a-z]\.){2,}")


def _sql_digest(items: str) -> str:
    return f"md5(array_to_string(list_sort({items}), ' '))"


@query("norm_clean", f"WITH {D.PREPARED} SELECT entity_id, n3 AS name_clean, md5(a3) AS address_digest, length(a3)::INT AS address_length FROM c3")
def norm_clean(spark, d):
    r = R.document_records(spark, d)
    a = X.clean(F.col("business_address"))
    return r.select("entity_id", X.clean(F.col("business_name")).alias("name_clean"), a.alias("a")).select("entity_id", "name_clean", F.md5("a").alias("address_digest"), F.length("a").alias("address_length"))


@query("norm_core", f"WITH {D.PREPARED} SELECT entity_id, country_key, name_n, name_core, name_nonlatin FROM prep")
def norm_core(spark, d):
    return R.prepared_documents(spark, d).select("entity_id", "country_key", "name_n", "name_core", "name_nonlatin")


@query("norm_address", f"WITH {D.PREPARED} SELECT entity_id, md5(addr_n) AS address_digest, array_to_string(nums, ' ') AS nums, array_to_string(list_filter(nums, lambda n: length(n) IN (5, 6)), ' ') AS postal FROM prep")
def norm_address(spark, d):
    return R.prepared_documents(spark, d).select("entity_id", F.md5("addr_n").alias("address_digest"), F.array_join("nums", " ").alias("nums"), F.array_join("postal", " ").alias("postal"))


@query("norm_url", "SELECT page_id, trim(regexp_replace(lower(url), " + D.q(X.L.URL) + ", ' \\1 ', 'g')) AS collapsed FROM pages")
def norm_url(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(X.collapse_urls(F.lower("url"))).alias("collapsed"))


@query(
    "norm_pages",
    f"WITH p2 AS (SELECT page_id, {D.bare(D.sub('html', '<[^>]*>', ' '))} AS t FROM pages), p3 AS (SELECT page_id, CASE WHEN regexp_matches(t, {DOTTED}) THEN {D.undotted('t')} ELSE t END AS t FROM p2) SELECT page_id, md5({D.letters('t')}) AS text_digest FROM p3",
)
def norm_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.clean(F.regexp_replace("html", "<[^>]*>", " "))).alias("text_digest"))


#: Latin letters and the Cyrillic ones that sound like them.
SPELLED = ("abdefgiklmnoprstuvz", "абдэфгиклмнопрстувз")


@query("norm_scripts", f"SELECT p_partkey, {D.letters('lower(p_name)')} AS name_clean FROM part")
def norm_scripts(spark, d):
    """Names of parts, every other one spelled in Cyrillic letters: transliteration undoes that."""
    name = F.when(F.col("p_partkey") % 2 == 1, F.translate(F.lower("p_name"), *SPELLED)).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.clean(name).alias("name_clean"))


@query("norm_unleet", "SELECT p_partkey, " + D.join(f"list_transform({D.words(chr(99))}, lambda t: {D.unleet('t')})") + " AS unleet FROM (SELECT p_partkey, lower(p_name) || ' ' || translate(lower(p_brand), '#', '') AS c FROM part)")
def norm_unleet(spark, d):
    c = F.concat(F.lower("p_name"), F.lit(" "), F.translate(F.lower("p_brand"), "#", ""))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(X.words(c), X.unleet), " ").alias("unleet"))


@query("sound_keys", f"WITH w AS (SELECT DISTINCT unnest({D.words('lower(p_name)')}) AS word FROM part) SELECT word, {D.sound_key('word')} AS sound FROM w")
def sound_keys(spark, d):
    w = table(spark, d, "part").select(F.explode(X.words(F.lower("p_name"))).alias("word")).distinct()
    return w.select("word", X.sound_key(F.col("word")).alias("sound"))


SPOKEN = "lower(c_name) || ' pvt ltd co ' || lower(c_mktsegment)"


@query("norm_tokenmap", "SELECT c_custkey, " + D.join(f"list_transform({D.words(SPOKEN)}, lambda t: coalesce({D.table(X.L.NAME_ABBREVIATIONS)}[t], t))") + " AS mapped FROM customer")
def norm_tokenmap(spark, d):
    """Abbreviations of names, word by word."""
    return table(spark, d, "customer").select("c_custkey", X.map_words(F.expr(SPOKEN), X.L.NAME_ABBREVIATIONS).alias("mapped"))


NUMBERED = "c_custkey || ' no ' || lpad(c_custkey::VARCHAR, 6, '0') || ' b 090 ' || c_nationkey || ' 12345'"
FOUND = "list_sort(list_distinct(regexp_extract_all(t, '[0-9]+')))"


@query("nums_postal", f"SELECT c_custkey, {D.join(FOUND)} AS nums, {D.join(f'list_filter({FOUND}, lambda n: length(n) IN (5, 6))')} AS postal, {D.join(f'list_transform({FOUND}, lambda n: ' + D.number('n') + ')')} AS bare FROM (SELECT c_custkey, {NUMBERED} AS t FROM customer)")
def nums_postal(spark, d):
    """Numbers of an address, those that may be postal codes, and without leading zeros."""
    t = F.expr(NUMBERED.replace("c_custkey::VARCHAR", "string(c_custkey)"))
    n = table(spark, d, "customer").select("c_custkey", X.numbers(t).alias("n"))
    return n.select("c_custkey", F.array_join("n", " ").alias("nums"), F.array_join(X.postal(F.col("n")), " ").alias("postal"), F.array_join(F.transform("n", X.bare_number), " ").alias("bare"))


def _token_query(name: str, retriever: str, make):
    sql = f"WITH {D.PREPARED}, {D.tokens(retriever)} SELECT entity_id, len(tokens)::INT AS n_tokens, {_sql_digest('tokens')} AS tokens_digest FROM lists"

    @query(name, sql)
    def run(spark, d):
        p = R.prepared_documents(spark, d).select("entity_id", make().alias("t"))
        return p.select("entity_id", F.size("t").alias("n_tokens"), digest(F.col("t")).alias("tokens_digest"))

    return run


_N, _C, _A = (lambda: F.col("name_n")), (lambda: F.col("name_core")), (lambda: F.col("addr_n"))
TOKEN_QUERIES = {"tok_uni": ("uni", lambda: K.unigrams(_N(), _C(), _A())), "tok_combo": ("combos", lambda: K.combos(_C(), _A())), "tok_sound": ("sounds", lambda: K.sounds(_C(), _A())), "tok_char": ("chars", lambda: K.characters(_C())), "tok_combo_ph": ("combo_ph", lambda: K.RETRIEVERS["combo_ph"](_N(), _C(), _A()))}


for _name, (_retriever, _make) in TOKEN_QUERIES.items():
    _token_query(_name, _retriever, _make)


@query("df_gate", f"WITH {D.PREPARED}, {D.tokens('uni')}, {D.weighted(LEAST_DF, MAX_DF)} SELECT country_key, df, count(*) AS tokens FROM wt_df GROUP BY ALL")
def df_gate(spark, d):
    t = B.tokens(R.prepared_documents(spark, d), "uni")
    df = t.groupBy("country_key", "token").agg(F.count("*").alias("df")).where(F.col("df").between(LEAST_DF, MAX_DF))
    return df.groupBy("country_key", "df").agg(F.count("*").alias("tokens"))


@query("idf_weights", f"WITH {D.PREPARED}, {D.tokens('uni')}, {D.weighted(LEAST_DF, MAX_DF)} SELECT entity_id, count(*) AS n_tokens, round(sum(idf), 4) AS idf_sum, round(max(w), 6) AS w_max, round(sum(w * w), 6) AS w_norm FROM wt GROUP BY ALL")
def idf_weights(spark, d):
    w = B.weighted(R.prepared_documents(spark, d), "uni", LEAST_DF, MAX_DF)
    return w.groupBy("entity_id").agg(F.count("*").alias("n_tokens"), F.round(F.sum("idf"), 4).alias("idf_sum"), F.round(F.max("w"), 6).alias("w_max"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("w_norm"))


@query("l2_norm", f"WITH {D.PREPARED}, {D.tokens('uni')}, {D.weighted(LEAST_DF, MAX_DF)}, n AS (SELECT country_key, entity_id, sum(w * w) AS s FROM wt GROUP BY ALL) SELECT country_key, count(*) AS records, sum((abs(s - 1) < 1e-9)::BIGINT)::BIGINT AS of_length_one FROM n GROUP BY country_key")
def l2_norm(spark, d):
    """Every record that has a token left has a vector of length one."""
    n = B.weighted(R.prepared_documents(spark, d), "uni", LEAST_DF, MAX_DF).groupBy("country_key", "entity_id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    return n.groupBy("country_key").agg(F.count("*").alias("records"), F.count_if(F.abs(F.col("s") - 1) < 1e-9).alias("of_length_one"))


def document_search(spark, d, retriever: str = "combo_ph", k_forward: int = B.K_FORWARD, k_reverse: int = B.K_REVERSE, held: DataFrame | None = None) -> DataFrame:
    return B.searched_records(R.prepared_documents(spark, d), retriever, LEAST_DF, MAX_DF, k_forward, k_reverse, held)


BLOCKED = f"{D.PREPARED}, {D.tokens('combo_ph')}, {D.weighted(LEAST_DF, MAX_DF)}, {D.SCORES}"


@query("block_forward", f"WITH {BLOCKED} SELECT s1_id, cand_id, fwd, round(score, 4) AS score FROM ranks WHERE fwd < 20")
def block_forward(spark, d):
    return document_search(spark, d).where("fwd IS NOT NULL").select("s1_id", "cand_id", F.col("fwd").cast("long").alias("fwd"), F.round("score", 4).alias("score"))


@query("block_reverse", f"WITH {BLOCKED} SELECT s1_id, cand_id, rev, round(score, 4) AS score FROM ranks WHERE rev < 3")
def block_reverse(spark, d):
    return document_search(spark, d).where("rev IS NOT NULL").select("s1_id", "cand_id", F.col("rev").cast("long").alias("rev"), F.round("score", 4).alias("score"))


@query("block_union", f"WITH {BLOCKED}, {D.candidates()} SELECT country_key, s1_id, cand_id, round(score, 4) AS score, fwd_rank, rev_rank FROM cand")
def block_union(spark, d):
    return B.clipped(document_search(spark, d)).withColumn("score", F.round("score", 4)).withColumns({"fwd_rank": F.col("fwd_rank").cast("int"), "rev_rank": F.col("rev_rank").cast("int")})


_RECALL = " UNION ALL ".join(
    [f"SELECT 'forward' AS search, {k} AS k, round(avg(coalesce(fwd < {k}, false)::INT), 6) AS recall FROM hits" for k in (5, 10, 20, 30, 50, 100)]
    + [f"SELECT 'reverse', {k}, round(avg(coalesce(rev < {k}, false)::INT), 6) FROM hits" for k in (1, 3, 5)]
    + [f"SELECT 'union', {k}, round(avg(coalesce(fwd < {k} OR rev < 3, false)::INT), 6) FROM hits" for k in (5, 10, 20, 30, 50, 100)]
)


@query("block_recall_at_k", f"WITH {BLOCKED}, {D.TRUTH}, hits AS (SELECT fwd, rev FROM truth t LEFT JOIN ranks r ON r.s1_id = t.s1 AND r.cand_id = t.m) {_RECALL}")
def block_recall_at_k(spark, d):
    return B.recall_at(R.document_truth(spark, d), document_search(spark, d, k_forward=100, k_reverse=5))


@query(
    "block_retriever_union",
    f"""WITH {D.PREPARED}, {D.tokens("combo")}, {D.weighted(LEAST_DF, MAX_DF)}, {D.SCORES}, r1 AS (SELECT s1_id, cand_id, fwd FROM ranks WHERE fwd < 20),
nt AS (SELECT entity_id, country_key, side, unnest(list_distinct(cw)) AS token FROM k1), {D.weighted(LEAST_DF, MAX_DF, "nt", "nw")},
s2 AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, sum(a.w * b.w) AS score FROM nw a JOIN nw b ON a.country_key = b.country_key AND a.token = b.token AND a.side = 1 AND b.side = 2 GROUP BY ALL HAVING sum(a.w * b.w) > 1e-9),
r2 AS (SELECT * FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 6) DESC, cand_id) - 1 AS fwd FROM s2) WHERE fwd < 10)
SELECT coalesce(r1.s1_id, r2.s1_id) AS s1_id, coalesce(r1.cand_id, r2.cand_id) AS cand_id, r1.fwd AS r_combo, r2.fwd AS r_name_words FROM r1 FULL JOIN r2 ON r1.s1_id = r2.s1_id AND r1.cand_id = r2.cand_id""",
)
def block_retriever_union(spark, d):
    a = document_search(spark, d, "combo").where("fwd IS NOT NULL").select("s1_id", "cand_id", F.col("fwd").alias("r_combo"))
    b = document_search(spark, d, "name_words", 10, 1).where("fwd IS NOT NULL").select("s1_id", "cand_id", F.col("fwd").alias("r_name_words"))
    return a.join(b, ["s1_id", "cand_id"], "full").select("s1_id", "cand_id", "r_combo", "r_name_words")


#: Benchmark items as source 1 (below zero, apart from documents' ids), all documents as the pool, in one block.
ITEMS = f"""
r0 AS (SELECT -1 - item_id AS entity_id, 1 AS side, text FROM benchmark UNION ALL SELECT doc_id, 2, text FROM documents),
r1 AS (SELECT entity_id, side, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w FROM r0),
rec AS (SELECT entity_id, array_to_string(w[1:{R.NAME_WORDS}], ' ') AS business_name, array_to_string(w[{R.NAME_WORDS + 1}:], ' ') AS business_address, '' AS country, side, false AS is_s3 FROM r1)"""


@query("link_benchmark", f"WITH {D.PREPARED.replace(D.RECORDS, ITEMS)}, {D.tokens('uni')}, {D.weighted(LEAST_DF, MAX_DF)}, {D.SCORES} SELECT -1 - s1_id AS item_id, cand_id AS doc_id, fwd, round(score, 4) AS score FROM ranks WHERE fwd < 3")
def link_benchmark(spark, d):
    """The three documents nearest to each benchmark item."""
    items = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("entity_id"), "text", F.lit(1).alias("side"))
    records = items.unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text", F.lit(2).alias("side")))
    p = X.prepare(R.text_records(records).withColumns({"country": F.lit(""), "is_s3": F.lit(False)}))
    found = B.searched(B.weighted(p, "uni", LEAST_DF, MAX_DF), 3, 1).where("fwd IS NOT NULL")
    return found.select((-1 - F.col("s1_id")).alias("item_id"), F.col("cand_id").alias("doc_id"), F.col("fwd").cast("long").alias("fwd"), F.round("score", 4).alias("score"))


@query("block_structured", "SELECT n_name AS country, c_custkey AS s1_id, s_suppkey AS cand_id FROM customer c JOIN nation ON n_nationkey = c_nationkey JOIN supplier s ON s_nationkey = c_nationkey WHERE c_acctbal > s_acctbal")
def block_structured(spark, d):
    c, s, n = (table(spark, d, x) for x in ("customer", "supplier", "nation"))
    j = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(s, F.col("s_nationkey") == F.col("c_nationkey")).where("c_acctbal > s_acctbal")
    return j.select(F.col("n_name").alias("country"), F.col("c_custkey").alias("s1_id"), F.col("s_suppkey").alias("cand_id"))


@query("ctx_group_stats", f"WITH {BLOCKED}, {D.candidates()} SELECT s1_id, cand_id, round(max(score) OVER (PARTITION BY s1_id), 4) AS s1_max, count(*) OVER (PARTITION BY s1_id) AS s1_n, round(max(score) OVER (PARTITION BY cand_id), 4) AS cand_max, count(*) OVER (PARTITION BY cand_id) AS cand_n FROM cand")
def ctx_group_stats(spark, d):
    s = B.group_stats(B.clipped(document_search(spark, d)))
    return s.select("s1_id", "cand_id", F.round("s1_max", 4).alias("s1_max"), "s1_n", F.round("cand_max", 4).alias("cand_max"), "cand_n")


@query("profile_coverage", f"WITH {D.PREPARED} SELECT country_key, side, count(*) AS records, round(avg((addr_n = '')::INT), 6) AS empty_address, round(avg((len(nums) > 0)::INT), 6) AS with_numbers, round(avg(length(name_core)), 4) AS core_length FROM prep GROUP BY ALL")
def profile_coverage(spark, d):
    p = R.prepared_documents(spark, d)
    return p.groupBy("country_key", "side").agg(
        F.count("*").alias("records"), F.round(F.avg((F.col("addr_n") == "").cast("int")), 6).alias("empty_address"), F.round(F.avg((F.size("nums") > 0).cast("int")), 6).alias("with_numbers"), F.round(F.avg(F.length("name_core")), 4).alias("core_length")
    )


@query("profile_matches", f"WITH {D.RECORDS}, {D.TRUTH}, per AS (SELECT least(coalesce(n, 0), 6) AS matches FROM rec LEFT JOIN (SELECT s1, count(*) AS n FROM truth GROUP BY s1) ON s1 = entity_id WHERE side = 1) SELECT matches, count(*) AS entities, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM per GROUP BY matches")
def profile_matches(spark, d):
    from pyspark.sql import Window as W

    n = R.document_truth(spark, d).groupBy("s1").agg(F.count("*").alias("n"))
    per = R.document_records(spark, d).where("side = 1").join(n, F.col("s1") == F.col("entity_id"), "left").select(F.least(F.coalesce("n", F.lit(0)), F.lit(6)).alias("matches"))
    return per.groupBy("matches").agg(F.count("*").alias("entities")).withColumn("share", F.round(F.col("entities") / F.sum("entities").over(W.partitionBy()), 6))


@query("profile_matrix", "SELECT source, sum((lang = 'de')::BIGINT)::BIGINT AS de, sum((lang = 'en')::BIGINT)::BIGINT AS en, sum((lang = 'es')::BIGINT)::BIGINT AS es, sum((lang = 'fr')::BIGINT)::BIGINT AS fr FROM documents GROUP BY source")
def profile_matrix(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@query("profile_pair_agreement", f"WITH {D.PREPARED}, {D.TRUTH} SELECT a.country_key, count(*) AS pairs, round(avg((a.name_core = b.name_core)::INT), 6) AS same_core, round(avg((a.addr_n = b.addr_n)::INT), 6) AS same_address, round(avg(CASE WHEN len(a.nums) > 0 AND len(b.nums) > 0 THEN list_has_any(a.nums, b.nums)::INT END), 6) AS share_number FROM truth JOIN prep a ON a.entity_id = s1 JOIN prep b ON b.entity_id = m GROUP BY ALL")
def profile_pair_agreement(spark, d):
    p = R.prepared_documents(spark, d).select("entity_id", "country_key", "name_core", "addr_n", "nums")
    b = p.select(F.col("entity_id").alias("m"), F.col("name_core").alias("core_b"), F.col("addr_n").alias("addr_b"), F.col("nums").alias("nums_b"))
    j = R.document_truth(spark, d).join(p.withColumnRenamed("entity_id", "s1"), "s1").join(b, "m")
    both = (F.size("nums") > 0) & (F.size("nums_b") > 0)
    return j.groupBy("country_key").agg(
        F.count("*").alias("pairs"), F.round(F.avg((F.col("name_core") == F.col("core_b")).cast("int")), 6).alias("same_core"), F.round(F.avg((F.col("addr_n") == F.col("addr_b")).cast("int")), 6).alias("same_address"),
        F.round(F.avg(F.when(both, F.arrays_overlap("nums", "nums_b").cast("int"))), 6).alias("share_number"),
    )


@query("profile_distractors", f"WITH {D.RECORDS}, {D.TRUTH} SELECT is_s3, count(*) AS records, round(avg((m IS NULL)::INT), 6) AS distractors FROM rec LEFT JOIN truth ON m = entity_id WHERE side = 2 GROUP BY is_s3")
def profile_distractors(spark, d):
    r = R.document_records(spark, d).where("side = 2").join(R.document_truth(spark, d), F.col("m") == F.col("entity_id"), "left")
    return r.groupBy("is_s3").agg(F.count("*").alias("records"), F.round(F.avg(F.col("m").isNull().cast("int")), 6).alias("distractors"))
