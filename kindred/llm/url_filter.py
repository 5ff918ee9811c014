"""URL filter (operator 6): path rules first, else logistic regression on hashed character n-grams, in DataFrame functions only.

The model is fitted on a small labelled URL table by gradient descent from zero. Its weights stay sums of the
examples' features, so the descent runs on one coefficient per example over the examples' kernel (shared n-grams),
inside one SQL expression; the weights of n-gram buckets follow by an aggregation. The table is small by contract: at
most `examples` rows of it, a parameter, are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let

#: Verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hash buckets, lengths of n-grams, rounds and rate of the descent, shrinkage.
BUCKETS, GRAMS, ROUNDS, RATE, SHRINK = 4096, (3, 4), 120, 0.5, 0.002
#: Labelled URLs to start with, by kinds of pages in general; a caller passes a table of their own.
BLOCKED = """
http://royal-casino.test/lobby
https://www.jackpot-casino.test/bonus
http://casino.slots.test/spin
https://poker-room.test/tables/join
http://sports-bets.test/odds/today
https://bets.gambling.test/free-spins
http://lottery-winner.test/claim-prize
https://you-win.test/prize/claim.php
http://pills-online.test/order
https://cheap-pharmacy.test/pills/buy
http://meds.discount-pills.test/cart
https://weight-loss-miracle.test/buy-now
http://xxx-videos.test/watch
https://adult-dating.test/join
http://live-cams.adult.test/room
https://singles-nearby.test/chat
http://crack-keygen.test/download.exe
https://warez.test/full-version-crack
http://torrent-serials.test/keygen.zip
https://free-download-manager.test/setup.exe
http://ads.bannerserver.test/show?zone=4
https://track.clickserver.test/redirect?u=1
http://pixel.adtrack.test/p.gif
https://popunder-ads.test/serve.js
http://affiliate-clicks.test/go?aff=77
https://tracking.mailer.test/open.gif
http://payday-loans.test/apply
https://instant-loan.test/no-credit-check
http://cheap-replica.test/watches
https://luxury-replica-bags.test/sale
http://make-money-fast.test/start
https://crypto-doubler.test/invest
http://account-verify-login.test/secure/update
https://bank-login-confirm.test/password
http://get-followers.test/cheap-likes
https://seo-backlinks.test/buy
""".split()
ALLOWED = """
http://daily-news.test/politics/report
https://www.courier.test/business/markets
http://weather.test/forecast/tomorrow
https://city-library.test/catalogue
http://museum.test/exhibitions/roman
https://www.university.test/research/papers
http://school.test/timetable
https://docs.language.test/tutorial/functions
http://wiki.test/Prime_number
https://encyclopedia.test/article/glacier
http://blog.garden.test/spring-planting
https://www.recipes.test/soup/lentil
http://health-service.test/vaccination
https://hospital.test/visitors
http://council.test/planning/applications
https://parliament.test/debates
http://railway.test/stations/map
https://airport.test/arrivals
http://books.test/authors/essays
https://history.test/archive/letters
http://music.test/scores/sonata
https://theatre.test/season
http://football-club.test/fixtures
https://cycling.test/routes/alps
http://www.travel.test/guide/lisbon
https://hotel.test/rooms
http://shop.test/kitchen/pans
https://furniture.test/tables/oak
http://forum.test/thread/compilers
https://m.reader.test/story
http://press.test/releases
https://jobs.test/engineer
http://photo.test/landscape
https://film.test/reviews
http://science.test/physics/optics
https://charity.test/about
""".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for texts without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """The distinct hash buckets of the character n-grams of host and path, in time in proportion to their lengths."""

    def grams(tag: str, text: Column) -> Column:
        # characters first: a substring at a position counts from the start of the text each time
        characters = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")

        def of(c: Column, n: int) -> Column:
            made = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(F.lit(f"{tag}{n}"), *[F.get(c, i + k) for k in range(n)]))
            return F.when(F.size(c) >= n, made).otherwise(F.array().cast("array<string>"))

        return let(characters, lambda c: F.concat(*[of(c, n) for n in GRAMS]))

    return F.array_distinct(F.transform(F.concat(grams("h", host), grams("p", path)), lambda g: F.conv(F.substring(F.md5(g), 1, 3), 16, 10).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, blocked (1 or 0)."""
    rows = ", ".join(f"('{u}', {y})" for y, us in ((1, BLOCKED), (0, ALLOWED)) for u in us)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS labelled(url, blocked)")


def fit(labelled: DataFrame, examples: int = 300) -> tuple[list[float], float]:
    """Bucket weights and bias of the logistic regression; labelled has url and blocked, rows with nulls are left out.

    At most `examples` rows train it, the first by hash; time and memory grow with their square.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").orderBy(F.md5("url"), "blocked").limit(examples)
    rows = rows.select(F.struct("url", F.col("blocked").cast("double").alias("y"), buckets(host, path).alias("f")).alias("e"))
    one = rows.agg(F.array_sort(F.collect_list("e")).alias("e"))
    share = lambda a, b: F.size(F.array_intersect(a["f"], b["f"])) / F.sqrt(F.greatest(F.size(a["f"]) * F.size(b["f"]), F.lit(1))) + 1.0
    one = cut(one.withColumn("k", F.transform("e", lambda a: F.transform("e", lambda b: share(a, b)))))  # else every step computes the kernel anew
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def step(alpha: Column, _: Column) -> Column:
        p = lambda i: 1 / (1 + F.exp(-total(F.zip_with(F.get("k", i), alpha, lambda x, y: x * y))))
        return F.transform(alpha, lambda a, i: a * (1 - RATE * SHRINK) - RATE * (p(i) - F.get("e", i)["y"]))

    one = one.withColumn("alpha", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.transform("e", lambda _: F.lit(0.0)), step))
    parts = one.select(F.explode(F.arrays_zip("e", "alpha")).alias("x")).select(F.col("x.e.f").alias("f"), F.col("x.alpha").alias("a"))
    found = parts.select(F.explode("f").alias("b"), (F.col("a") / F.sqrt(F.size("f"))).alias("a")).groupBy("b").agg(F.sum("a").alias("w"))
    weights = [0.0] * BUCKETS
    for r in found.collect():  # BUCKETS rows at most
        weights[r["b"]] = r["w"]
    return weights, parts.agg(F.coalesce(F.sum("a"), F.lit(0.0))).first()[0]


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (verdict, rule) that fits host and path, or null; of equally long ones, block."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(int(v == "block")).alias("block"), F.lit(h + p).alias("rule")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,block:int,rule:string>")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", examples: int = 300) -> DataFrame:
    """key, host, path, rule, verdict, p_block for each row of pages; a narrow job over the url column alone.

    Null or empty urls and those without :// have empty host and path, no rule, and the model's verdict on no n-grams
    but the borders. Repeated rows repeat their result, null keys are kept, other columns are not read; urls may have
    any length. labelled is the table that trains the model (url, blocked), an empty one blocks nothing.
    """
    weights, bias = fit(labelled, examples)
    df = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("_u"))
    host, path = host_and_path(F.col("_u"))
    df = df.select(key, host.alias("host"), path.alias("path"))
    df = df.withColumn("_b", buckets(F.col("host"), F.col("path"))).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    table = F.lit(weights)
    score = F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.sqrt(F.greatest(F.size("_b"), F.lit(1))) + F.lit(bias)
    df = df.withColumn("_p", 1 / (1 + F.exp(-score)))
    verdict = F.when(F.coalesce(F.col("_rule.block"), (F.col("_p") > 0.5).cast("int")) == 1, "block").otherwise("allow")
    return df.select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.round("_p", 3).alias("p_block"))


def oracle() -> str:
    """DuckDB SQL for judge(pages, labelled_urls)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",".join(f"({q(u)},{y}::DOUBLE)" for y, us in ((1, BLOCKED), (0, ALLOWED)) for u in us)
    rules = ",".join(f"({q(h)},{q(p)},{q(v)})" for v, h, p in RULES)

    def parsed(source: str, rest: str) -> str:
        return f"""SELECT {rest}, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM {source})"""

    def feats(source: str) -> str:
        grams = " || ".join(f"list_transform(range(1, length({t}) + 4 - {n}), lambda i: '{tag}{n}' || substr('^' || {t} || '$', i::INT, {n}))" for tag, t in (("h", "host"), ("p", "path")) for n in GRAMS)
        return f"SELECT *, list_sort(list_distinct(list_transform({grams}, lambda g: ('0x' || substr(md5(g), 1, 3))::INT))) AS f FROM ({source})"

    return f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {rows}),
ex AS (SELECT row_number() OVER (ORDER BY url) AS i, y, f FROM ({feats(parsed("labelled", "url, y"))})),
kernel AS (SELECT a.i, list(len(list_intersect(a.f, b.f)) / sqrt(len(a.f) * len(b.f)) + 1.0 ORDER BY b.i) AS row FROM ex a, ex b GROUP BY a.i),
k AS (SELECT list(row ORDER BY i) AS k, (SELECT list(y ORDER BY i) FROM ex) AS y FROM kernel),
fit(n, alpha) AS (
  SELECT 0, list_transform(y, lambda v: 0.0::DOUBLE) FROM k
  UNION ALL
  SELECT n + 1, list_transform(range(1, len(alpha) + 1), lambda i: alpha[i] * (1 - {RATE * SHRINK}) - {RATE} * (1 / (1 + exp(-list_dot_product(k[i], alpha))) - y[i]))
  FROM fit, k WHERE n < {ROUNDS}),
parts AS (SELECT f, alpha[i] AS a FROM ex, (SELECT alpha FROM fit WHERE n = {ROUNDS})),
weights AS (SELECT b, sum(a) AS w FROM (SELECT unnest(f) AS b, a / sqrt(len(f)) AS a FROM parts) GROUP BY b),
p AS (SELECT row_number() OVER () AS rid, * FROM ({feats(parsed("pages", "page_id"))})),
scores AS (SELECT rid, sum(coalesce(w, 0)) AS s FROM (SELECT rid, unnest(f) AS b FROM p) LEFT JOIN weights USING (b) GROUP BY rid),
judged AS (SELECT page_id, host, path, 1 / (1 + exp(-(coalesce(s, 0) / sqrt(greatest(len(f), 1)) + (SELECT sum(a) FROM parts)))) AS prob,
  (SELECT arg_max([h || q, v], length(h || q)) FROM (VALUES {rules}) r(h, q, v) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS best
  FROM p LEFT JOIN scores USING (rid))
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN prob > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(prob, 3) AS p_block FROM judged"""
