"""PII surrogates, secrets, URL rules, quality and language-model scores on small hand-made tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.llm import common, lm_score, pii, quality, queries, secrets, url_filter

from ..conftest import SMALL


def test_surrogates(docs):
    rows = [(1, "Mail Bob.Ray@Mail7.Example.com or bob.ray@mail7.example.com, ip 97.51.17.173; +1 (017) 555-7713."), (2, "Mr. John Smith met Mrs. Smith and Dr Ольга Петрова. Card 4111 1111 1111 1111 and 9807915762804490!"), (3, None), (4, ""), (5, "nothing 12 here 1.2.3 or 999.1.1.1"), (6, "SSN 123-45-6789 IBAN DE89370400440532013000 x."), (6, "SSN 123-45-6789 IBAN DE89370400440532013000 x."), (None, "x@y.org"), (7, "John Smith, x@y.org " + "word " * 50_000)]
    d = docs(rows).withColumnRenamed("n_chars", "n_entities")
    got = pii.pseudonymise(d, "key").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_entities"}
    by = {r["doc_id"]: r["text"] for r in got}
    n = {r["doc_id"]: r["n_entities"] for r in got}
    assert by[3] is None and by[4] == "" and by[5] == rows[4][1] and (n[1], n[2], n[3], n[5], n[6]) == (4, 5, 0, 0, 2)
    a, b = re.findall(r"\S+@\S+\w", by[1])
    assert a.lower() == b.lower() != "bob.ray@mail7.example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", a)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[1]) and re.search(r" ip \d\d\.\d\d\.\d\d\.\d{3};", by[1])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and Dr (\w+) (\w+)\. Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})!", by[2])
    assert m and m[2] == m[3] and m[1] in pii.GIVEN["m"] and m[4] in pii.GIVEN["f"] and re.fullmatch("[А-Я][а-я]+", m[5])
    digits = [int(c) for c in m[6].replace(" ", "")]
    assert sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0  # a valid card stays valid
    assert by[7].startswith(f"{m[1]} {m[2]}, ") and by[7].split()[2] == by[None]
    assert re.fullmatch(r"SSN \d{3}-\d\d-\d{4} IBAN DE\d{20} x\.", by[6])
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(d, "another key").collect()}
    assert other[1] != by[1] and pii.pseudonymise(docs([]), "key").count() == 0


def test_surrogates_stay_distinct(docs):
    """Formats with few values: first draws collide, and distinct entities must not."""
    rows = [(i, f"a@b{i % 10}.example.com {i % 9 + 1}.1.1.{i % 10} c{i}@d.example.com") for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(rows), "key").collect()}
    seen = {}
    for i, t in rows:
        for a, b in zip(t.split(), got[i].split(), strict=True):
            assert seen.setdefault(a, b) == b  # coreference
    real = set(seen)
    assert len(set(seen.values())) == len(seen) and not real & set(seen.values())


def test_surrogates_of_hostile_texts(docs):
    """Domains of very many labels and very long words end neither the matcher nor the job."""
    texts = ["x@" + "a." * 100_000 + "com", "x@" + "ab." * 100_000 + "com end", "a" * 10_000_000, "é@" * 100_000, "x@y.org " + "w" * 2_000_000 + " u@v.org", "1" * 300_000, "Mr " * 20_000 + "Mr John Smith"]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(list(enumerate(texts))), "key").collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[5] == texts[5] and "John" not in got[6]
    assert not got[4].startswith("x@y.org ") and "u@v.org" not in got[4] and got[1] != texts[1]


def test_draws_are_those_of_a_plain_loop(spark):
    """Distinct surrogates by rounds over all entities, as a loop over a dictionary does it."""
    rows = [("name", a + b) for a in "bcdfghkl" for b in "aeiour"]  # 48 names of two letters, 65 surrogates
    found = spark.createDataFrame(rows * 2, "kind string, norm string")
    got = {(r["kind"], r["norm"]): r["draw"] for r in pii.draws(found, "key").collect()}
    real = sorted({r["norm"] for r in found.collect()})
    columns = [F.lower(pii.surrogate(F.col("kind"), F.col("norm"), F.lit(n), "key")).alias(str(n)) for n in range(16)]
    made = {r["norm"]: r for r in found.select("norm", *columns).collect()}  # what each draw makes of each entity
    todo, taken, want, n = real, set(), {}, 0
    while todo and n < 16:
        rest, new = [], {}
        for e in todo:
            m = made[e][str(n)]
            if m in real or m in taken or m in new:
                rest.append(e)
            else:
                new[m] = e
        want |= {("name", e): n for e in new.values() if n}
        taken |= set(new)
        todo, n = rest, n + 1
    assert not todo and got == want and len(got) > 3


def spans(text):
    out = []
    for kind, (pattern, least, group) in {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]+", 24, 0)}.items():
        out += [(m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(docs):
    key = "Zk3" * 10
    texts = ["", "é😀 token = \"abcdef\" x", "token = token : abcdefgh", "passwd:12345 API_KEY='a.b/c+d=e-f'", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2, "ſecret=abcdefgh Token=short", f"live {key} here", "secret: " + "f" * 40]
    texts += [f"shared {'Ab1' * 9}"] * 6 + ["word " * 30_000 + "token=abcdefghi", "api_key=abcdef " * 1500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "secret=abcdefgh"), (8, texts[8])]
    got = secrets.scan(docs(rows).withColumnRenamed("n_chars", "spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "" if r["doc_id"] == 500 else "secret=abcdefgh" if r["doc_id"] is None else texts[r["doc_id"]]
        assert r["base_spans"] == spans(t), t[:80]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [spans(t).count(f"{k}:") for k in ("assign", "access", "hex")]
        base, all_ = set(filter(None, r["base_spans"].split(","))), set(filter(None, r["spans"].split(",")))
        assert base <= all_ and all(s.startswith("mixed:") for s in all_ - base)
    by = {r["doc_id"]: r for r in got}
    assert by[7]["spans"] == f"mixed:5:{5 + len(key)}" and by[7]["n_live"] == 1
    assert by[9]["spans"] == "" and by[9]["n_example"] == 1  # three owners have it: an example
    assert by[9]["n_owners"] == 3 and by[0]["n_owners"] == by[0]["n_repositories"] == 0 and by[7]["n_repositories"] == 1
    assert secrets.scan(docs([])).count() == 0


def test_ownership_of_hot_and_copied_values(spark, monkeypatch):
    """A value in most rows goes another way through the join; many repositories of one owner make an example too."""
    hot, copied, own = "Hot1" * 6, "Cop2" * 6, "Own3" * 6
    rows = [(i, f"x {hot}", "en", f"src{i % 5}") for i in range(60)] + [(100 + i, f"{copied} y", f"r{i}", "src9") for i in range(6)] + [(200 + i, f"{own} z", f"r{i}", "src9") for i in range(5)]
    rows += [(300, f"x {hot}", "en", "src0")] * 30 + [(None, f"x {hot}", "en", "src0"), (None, None, None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for few in (common.HOT, 3):
        monkeypatch.setattr(common, "HOT", few)
        got = secrets.scan(d).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        for r in got:
            i = 0 if r["doc_id"] is None else r["doc_id"]
            want = (5, 5, 0) if i < 100 or i == 300 else (1, 6, 0) if i < 200 else (1, 5, 1)
            assert (r["n_owners"], r["n_repositories"], r["n_live"]) == ((0, 0, 0) if r["doc_id"] is None and not r["n_owners"] else want)


def test_url_rules(spark):
    urls = {
        "http://Sub.Example.ORG/es/x": ("sub.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"), "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"), "http://a.com/fr/#x": ("a.com", "/fr/", "com/fr/", "allow"), "http://casino-win.example.net/play": ("casino-win.example.net", "/play", None, "block"),
        "http://news.example.net/en/report": ("news.example.net", "/en/report", None, "allow"), "http://É.org?x://y/z": ("É.org", "", None, None), "x://y.org://z.com/a": ("y.org:", "//z.com/a", None, None), "a\n://b.org/c\nd": ("b.org", "/c\nd", "org/", "allow"), "no scheme": ("", "", None, None),
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(99, None, "x"), (98, "", "x"), (97, "http://a.org/" + "x" * 100_000, "x"), (97, "http://a.org/x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.judge(pages, url_filter.labelled_urls(spark)).collect()
    assert len(got) == len(rows)
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = next(x for x in got if x["page_id"] == i)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert all((r["host"], r["path"], r["rule"]) == ("", "", None) for r in got if r["page_id"] in (98, 99))
    assert url_filter.judge(pages.limit(0), url_filter.labelled_urls(spark)).count() == 0
    assert url_filter.judge(pages, url_filter.labelled_urls(spark).limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0  # knows nothing, blocks nothing


def test_urls_of_any_length(spark):
    rows = [(1, "http://host.example/" + "x/y-" * 250_000), (2, "http://" + "h" * 200_000 + ".test/"), (3, "q" * 300_000)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.labelled_urls(spark)).collect()}
    assert len(got[1]["path"]) == 1_000_001 and len(got[2]["host"]) == 200_005 and got[3]["host"] == got[3]["path"] == ""


def test_urls_held_out(spark):
    """The same kinds of pages, other hosts: none of these is in the labelled table."""
    block = ["http://grand-casino.invalid/play", "https://poker.invalid/join", "http://bets-today.invalid/odds", "https://cheap-pills.invalid/buy", "http://pharmacy-meds.invalid/order", "http://xxx.invalid/videos", "https://adult-chat.invalid/cams", "http://keygen.invalid/crack.exe", "http://warez-download.invalid/setup.exe", "https://ads.invalid/show?zone=1", "http://clicktracking.invalid/redirect", "https://replica-watches.invalid/sale", "http://payday-loan.invalid/apply", "http://lottery-prize.invalid/claim"]
    allow = ["http://evening-news.invalid/report", "https://library.invalid/catalogue/authors", "http://wiki.invalid/Physics", "https://docs.invalid/tutorial", "http://university-research.invalid/papers", "http://recipes-blog.invalid/soup", "https://museum-guide.invalid/exhibitions", "http://weather-report.invalid/forecast", "http://science-journal.invalid/article", "https://history-archive.invalid/letters", "http://football.invalid/fixtures", "https://theatre-reviews.invalid/season", "http://council-planning.invalid/debates", "https://travel-guide.invalid/routes"]
    known = set(url_filter.BLOCKED + url_filter.ALLOWED)
    assert not known & {*block, *allow}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(block + allow)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.labelled_urls(spark)).collect()}
    right = sum(got[i] == ("block" if i < len(block) else "allow") for i in got)
    assert right >= 0.85 * len(got)


def test_estimates_are_those_of_plain_loops():
    """Expectation-maximisation written out vote by vote."""
    import numpy as np

    rng = np.random.default_rng(5)
    truth = rng.random(400) < 0.6
    skill = [0.9, 0.8, 0.7, 0.6]
    votes = [[2 if rng.random() < 0.2 else int(t) if rng.random() < q else 1 - int(t) for q in skill] for t in truth]
    seen = Counter(map(tuple, votes))
    patterns, counts = np.array(list(seen)), np.array(list(seen.values()), dtype=float)
    post, rates, prior = quality.estimate(patterns, counts)
    p = {v: min(0.95, max(0.05, (v.count(1) + 1) / (v.count(1) + v.count(0) + 2))) for v in seen}
    for _ in range(quality.EM_ROUNDS):
        r = [[[1.0] * 3 for _ in skill] for _ in range(2)]
        mass = [0.0, 0.0]
        for v, n in seen.items():
            for c, w in ((0, (1 - p[v]) * n), (1, p[v] * n)):
                mass[c] += w
                for j, x in enumerate(v):
                    r[c][j][x] += w
        r = [[[x / sum(one) for x in one] for one in of] for of in r]
        share = min(0.99, max(0.01, mass[1] / sum(mass)))
        for v in seen:
            good, bad = share, 1 - share
            for j, x in enumerate(v):
                good, bad = good * r[1][j][x], bad * r[0][j][x]
            p[v] = good / (good + bad)
    assert prior == pytest.approx(share) and rates == pytest.approx(np.array(r))
    assert post == pytest.approx([p[tuple(v)] for v in patterns.tolist()])
    sure = [(p[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]
    assert sum(sure) / len(sure) > 0.85


def test_scorer_is_that_of_plain_loops(monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "ROUNDS", 25)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        b = np.unique(rng.integers(0, 12, 4))
        rows.append((b, rng.random(len(b)) + 0.1, float(b[0] < 4)))
    w, bias = quality.train(rows)
    v, c, sv, sc = [0.0] * quality.BUCKETS, 0.0, [1e-8] * quality.BUCKETS, 1e-8
    for _ in range(25):
        g, gc = [quality.SHRINK * x for x in v], 0.0
        for b, x, y in rows:
            e = (1 / (1 + math.exp(-(sum(v[i] * t for i, t in zip(b, x, strict=True)) + c))) - y) / len(rows)
            gc += e
            for i, t in zip(b, x, strict=True):
                g[i] += e * t
        for i, t in enumerate(g):
            sv[i] += t * t
            v[i] -= 0.3 * t / math.sqrt(sv[i])
        sc += gc * gc
        c -= 0.3 * gc / math.sqrt(sc)
    assert w == pytest.approx(np.array(v), abs=1e-6) and bias == pytest.approx(c, abs=1e-6)


def test_labellers_at_any_length():
    import numpy as np

    once = np.arange(1000, dtype=np.uint64)
    assert quality.distinct(once) == quality.distinct(np.tile(once, 50)) == 1.0
    assert quality.distinct(np.tile(once[:100], 55)) == pytest.approx(0.1) and quality.distinct(once[:1]) == 1
    assert quality.shape(b"A" * 100 + b"-" * 90 + b"12" * 50 + b"x" * 70) == b"X--9x" and quality.shape(b"a-b." * 20) != quality.shape(b"a-b." * 21)


def test_training_sample_is_bounded_by_rows(docs):
    """A key that most rows have trains once."""
    rows = [(1, "A normal line of the text. It ends here, as lines do.")] * 500 + [(i, f"Line {i} of the text is in order. It ends here.") for i in range(2, 30)] + [(1, "!!! ### $$$ @@@ %%% ^^^ &&& " * 20)]
    assert quality.classify(docs(rows), train_rows=10).count() == len(rows)
    long = "Some words of the text. " * 20_000 + "w" * 1_000_000
    assert quality.classify(docs([(1, long), (1, long), (None, "a")])).count() == 3


def test_quality_on_labels(spark):
    folder = SMALL.replace("0.001", "0.01")
    d = spark.read.parquet(f"{folder}/documents.parquet")
    got = quality.classify(d).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = Counter((r["quality"], r["kept"]) for r in got.collect())
    assert n[1, True] / (n[1, True] + n[1, False]) >= 0.98 and n[0, False] / (n[0, True] + n[0, False]) >= 0.95


def test_quality_of_odd_rows(docs):
    rows = [(i, f"This is an ordinary sentence number {i} of the text. It has words and ends." * 3) for i in range(40)] + [(100, None), (101, ""), (102, "\n \n"), (None, "A normal line of the text. It ends here."), (5, "again")]
    d = docs(rows).withColumnRenamed("n_chars", "score")
    got = quality.classify(d).collect()
    assert len(got) == len(rows) and all(not r["kept"] and r["score"] == 0 for r in got if r["doc_id"] in (100, 101, 102))
    kept = quality.accepted(d)
    assert kept.columns == d.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.classify(docs([])).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_backoff(docs, monkeypatch, order):
    monkeypatch.setattr(lm_score, "CHUNK", 50)
    texts = ["a b c d a b", "A B c", "c d e f g", "z", "", None, "a b c d a b", "q " * 200 + "a b"]
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs(list(enumerate(texts))).withColumnRenamed("n_chars", "n_words"), order=order).collect()}
    for i, w in enumerate(words):
        rest = {n: sum((grams(x, n) for j, x in enumerate(words) if j != i), Counter()) for n in range(1, order + 1)}
        total = max(1, sum(len(x) for j, x in enumerate(words) if j != i))
        s = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                c = rest[n][tuple(w[k - n + 1 : k + 1])]
                if n == 1:
                    s += math.log(max(c, 0.5) / total)
                elif c:
                    s += math.log(c / rest[n - 1][tuple(w[k - n + 1 : k])])
                    break
                else:
                    s += math.log(0.4)
        assert got[i]["n_words"] == len(w)
        assert got[i]["log_score"] is None if not w else got[i]["log_score"] == pytest.approx(s / len(w), abs=1e-4)
    assert lm_score.score_documents(docs([])).count() == 0


def test_query_sees_orders_of_three(spark, docs, tmp_path):
    """Known pairs of words in an unknown order of three back off."""
    texts = ["x a b y", "z b c w", "a b c", "u a b y", "one", "", None]
    docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    known = {r["doc_id"]: r["n_known"] for r in queries.QUERIES["op3_lm_score"](spark, str(tmp_path)).collect()}
    assert known[2] == 0 and known[0] == known[3] == 1 and known[4] == known[5] == known[6] == 0


def test_backoff_of_tables_read_twice(spark, docs, tmp_path):
    """Equal partitions are chunks of their own, also after a shuffle; long words are hashed, not kept."""
    docs([(i, f"a b c {i % 3} d") for i in range(20)] + [(50, "w" * 1_000_000 + " a b")]).coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    for twice in (d.union(d), d.union(d).repartition(3)):
        got = lm_score.score_documents(twice).collect()
        assert len(got) == 42 and all(r["n_known"] == r["n_words"] - 2 for r in got)
    with pytest.raises(TypeError):
        lm_score.score_documents(d.withColumn("doc_id", F.lit("x")))
