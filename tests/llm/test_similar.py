"""Near-duplicates, embedding links, decontamination and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kindred.llm import common
from kindred.llm import decontamination as C
from kindred.llm import embedding_links as E
from kindred.llm import near_duplicates as N
from kindred.llm.common import connected_components


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7)]
    want = components({x for p in links for x in p}, links)
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {x for x in want if all(a == b for a, b in links if x in (a, b))}
    assert got == {k: v for k, v in want.items() if k not in alone}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_rows(rng, groups=25):
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(6, 80))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((at, " ".join(t)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "two words"), (at + 4, "TWO\twords"), (at + 5, "two words é"), (at + 6, "x " * 40_000), (at + 7, "x " * 39_999)]
    return rows


@pytest.mark.parametrize("node", [400, 4])
def test_near_duplicates(docs, monkeypatch, node):
    """A small node size sends groups through all levels and into blocks."""
    monkeypatch.setattr(N, "NODE", node)
    rows = near_rows(random.Random(2))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = N.near_duplicates(docs(rows).withColumnRenamed("n_chars", "n_shingles")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, len(s), want[i], want[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("depth", [1, 10])
def test_recall_at_the_threshold(docs, monkeypatch, depth):
    """Pairs at 0.75 to 0.8 in nodes that all have to branch, or to be compared in chunks and blocks."""
    monkeypatch.setattr(N, "NODE", 8)
    monkeypatch.setattr(N, "DEPTH", depth)
    rng = random.Random(12)
    common = [f"c{i}" for i in range(6)]  # a passage that all share, so that nodes are large
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(70)]
        rows.append((2 * i, " ".join(words + common)))
        for p in rng.sample(range(8), 1):  # one word changed in the middle: 5 of 68 shingles go, twice over
            for at in (10 + p, 40 + p):
                words[at] = f"v{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words + common)))
    sets = {i: shingles(t) for i, t in rows}
    near = [i for i in range(150) if 75 <= 100 * len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) <= 80]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(rows)).collect()}
    assert len(near) == 150 and sum(got[2 * i + 1] == 2 * i for i in near) >= 0.98 * len(near)
    assert all(got[2 * i] == 2 * i for i in range(150))


def test_dense_group_is_linked_by_its_pivot_and_the_rest_by_blocks(docs, monkeypatch):
    """A large group that never shrinks, and a chain that leaves it: like a member, unlike the smallest class."""
    monkeypatch.setattr(N, "NODE", 6)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    w = rows[59][1].split()
    for k in range(4):  # each step away from the one before
        w = w[:-4] + [f"y{k}{j}" for j in range(4)] if k % 2 else [f"z{k}{j}" for j in range(4)] + w[4:]
        w = w + [f"q{k}{j}" for j in range(6)]
        rows.append((100 + k, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(rows)).collect()}
    assert got == want and len(set(want.values())) < 5


def test_one_key_with_several_texts(docs):
    """Links of a key are those of all its texts."""
    a, b = "one two three four five six seven", "eins zwei drei vier fünf sechs sieben"
    got = N.near_duplicates(docs([(5, a), (5, b), (2, a), (3, b), (9, "other words stand here for themselves")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (3, 2), (5, 2), (5, 2), (9, 9)]
    with pytest.raises(TypeError):
        N.near_duplicates(docs([(1, "a")]).selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_near_duplicates_of_odd_rows(docs):
    got = sorted(map(tuple, N.near_duplicates(docs([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")])).collect()), key=str)
    assert got == sorted([(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 2, None, True)], key=str)
    assert N.near_duplicates(docs([])).count() == 0 and N.deduplicate(docs([(1, "a"), (2, "a")])).count() == 1


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    for i in range(100, 220):  # near copies around the bound, and one large group
        x[i] = x[i % 10] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.45])
    x[220:240] = x[0]
    x[240] = x[1] * 1e-30
    x[241] = x[1] * 1e30
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [], 0), (906, [float(v) for v in x[0][:8]], 0), (None, [float(v) for v in x[0]], 0)]
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    linked = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    want = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True) if a < b])
    got = {r["vec_id"]: r for r in E.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    exact = sum(got[i]["n_links"] == linked[i].sum() for i in range(len(x)))
    found, all_ = sum(got[i]["n_links"] for i in range(len(x))), int(linked.sum())
    assert found <= all_ and found >= 0.97 * all_ and exact >= 0.9 * len(x)  # none below the bound; recall
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert E.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_one_key_with_several_vectors(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    d = spark.createDataFrame([(5, x), (5, y), (5, x), (2, x), (3, y), (9, [0.0, 0.0, 2.0])], "vec_id long, embedding array<double>")
    got = E.embedding_links(d).collect()
    assert len(got) == 6 and {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] == 9} == {9: (0, 9)}
    two, three = ((r["n_links"], r["component_id"]) for r in sorted((r for r in got if r["vec_id"] in (2, 3)), key=lambda r: r["vec_id"]))
    assert sorted([two[0], three[0]]) == [0, 1] and two[1] == 2 and three[1] == 3
    with pytest.raises(TypeError):
        E.embedding_links(d.selectExpr("string(vec_id) AS vec_id", "embedding"))


def test_pivots_are_spread_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    sample = E.unit(rng.standard_normal((300, 6)))
    want = []
    for v in sample:
        if all(v @ w < E.APART for w in want):
            want.append(v)
    for block in (1024, 7):
        monkeypatch.setattr(E, "BLOCK", block)
        assert np.array_equal(E.spread(sample, 40), np.array(want[:40])) and np.array_equal(E.spread(sample, 9999), np.array(want))


def edit_distance_within(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_leaks(spark, docs):
    rng = random.Random(4)
    words = ["the", "onhahest", "eri", "ti", "é", "中文", "of", "a", "b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(1, 20))) for i in range(40)] + [(100, None), (101, ""), (102, "abc")]
    rows = [(1000, None), (1001, ""), (1002, "zabcz"), (1004, "z ABC z"), (1003, "q " * 100_000 + items[3][1])]
    for i in range(60):
        s = list(rng.choice(items[:40])[1])
        for _ in range(rng.randint(0, max(1, int(len(s) * 0.13)))):
            p, o = rng.randrange(len(s) + 1), rng.random()
            if o < 0.4 and s:
                s[min(p, len(s) - 1)] = rng.choice("xyzé")
            elif o < 0.7:
                s.insert(p, rng.choice("xyz q"))
            elif s:
                del s[min(p, len(s) - 1)]
        rows.append((i, text(rng.randint(0, 20)) + " " + "".join(s).upper() + "\n\t" + text(rng.randint(0, 10))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        for j, b in items:
            t_, b_ = C.normal(t), C.normal(b)
            if b_ and ((f" {b_} " in f" {t_} " if len(b_) < C.Q else b_ in t_) or len(b_) >= C.Q and len(t_) < 2000 and edit_distance_within(b_, t_) <= C.budget(len(b_))):
                want.add((i, j))
    got = {(r["doc_id"], r["item_id"]) for r in C.find_leaks(docs(rows).withColumnRenamed("n_chars", "start"), bench).collect()}
    assert {x for x in got if x[0] != 1003} == {x for x in want if x[0] != 1003} and (1003, 3) in got
    blocks = C.find_leaks(docs(rows), bench, block_chars=300)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got
    assert {r["doc_id"] for r in C.decontaminate(docs(rows), bench).collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert {r["doc_id"] for r in C.decontaminate(docs(rows), bench, block_chars=300).collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert C.find_leaks(docs([]), bench).count() == 0 and C.find_leaks(docs(rows), bench.where("false")).count() == 0
    named = bench.selectExpr("concat('b', item_id) AS name", "text AS body")
    other = C.find_leaks(docs(rows).withColumnRenamed("doc_id", "_text"), named, key="_text", item="name", item_text="body").collect()
    assert {(r["_text"], r["item_id"]) for r in other} == {(i, f"b{j}") for i, j in got}
    nameless = docs([(None, "x " + items[3][1]), (None, "clean"), (None, None), (5, "")])
    assert sorted(map(str, C.decontaminate(nameless, bench).select("doc_id", "text").collect())) == sorted(["Row(doc_id=None, text='clean')", "Row(doc_id=None, text=None)", "Row(doc_id=5, text='')"])


def test_dense_texts_as_others():
    """Repeated q-grams: the way of dense texts finds what the way of others finds, in windows too."""
    rng = random.Random(8)
    items = ["-" * 60, "ab" * 40, "-" * 30 + " end of the rule " + "-" * 30, "one line of words and then " + "=" * 40]
    texts = ["-" * 500, "ab" * 300 + "x", "x".join("-" * rng.randint(20, 70) for _ in range(40)), "=" * 100 + " one line of words and then " + "=" * 39 + "-" * 200, "plain words only here"]
    texts += ["".join(rng.choice(["-" * 28, "ab" * 20, " end of the rule ", "=" * 39, "one line of words and then ", "x"]) for _ in range(12)) for _ in range(60)]
    index = C.Index(list(enumerate(items)), C.RATE)
    want = index.matches(texts)
    assert len(want) > 40
    for hits, step in ((0, 400_000), (0, 10), (1_000_000, 10)):
        old = C.HITS, C.STEP
        try:
            C.HITS, C.STEP = hits, step
            got = index.matches(texts)
        finally:
            C.HITS, C.STEP = old
        assert got == want


def test_a_million_dashes_in_bounded_memory():
    import tracemalloc

    index = C.Index([(1, "-" * 120), (2, "-" * 119 + "x")], C.RATE)
    tracemalloc.start()
    got = index.matches(["-" * 1_000_000, "-" * 100 + "y" + "-" * 100])
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert (0, 0, 0, 120, 0) in got and [r[:2] for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize("most", [500_000, 20])
def test_links_are_contracted_in_tasks(spark, monkeypatch, most):
    """So many links as one task takes need no rounds of shuffles; more are contracted before the rounds."""
    monkeypatch.setattr(common, "CONTRACTED", most)
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df, f=common.cut: cuts.append(1) or f(df))
    rng = random.Random(4)
    links = [(i + 1, i) for i in range(300)] + [(5000, 6000 + i) for i in range(80)] + [(-5, 2**62), (7000, 7000)] + [(rng.randint(8000, 8200), rng.randint(8000, 8200)) for _ in range(150)]
    rng.shuffle(links)
    real = [(a, b) for a, b in links if a != b]
    want = components({x for p in real for x in p}, real)
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert len(cuts) == 2 or most == 20


@pytest.mark.parametrize("most", [500_000, 1])
def test_only_ids(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "k long")
    for kind in ("int", "long"):
        rows = spark.createDataFrame([(i,) for i in [*range(500), None]], f"k {kind}")
        assert sorted(r[0] for r in common.only_ids(rows, ids, "k").collect()) == list(range(0, 400, 2))
        kept = [r[0] for r in common.only_ids(rows, ids, "k", "left_anti").collect()]
        assert None in kept and sorted(x for x in kept if x is not None) == [i for i in range(500) if i % 2 or i >= 400]


@pytest.mark.parametrize("within", [30, 50_000])
def test_large_nodes_branch_by_tasks_or_rounds(docs, monkeypatch, within):
    """Nodes of a passage that all share, of alike documents and of others, by either way or both; tasks take the same few jobs at any depth."""
    monkeypatch.setattr(N, "NODE", 6)
    monkeypatch.setattr(N, "WITHIN", within)
    monkeypatch.setattr(N, "DEPTH", 4)
    rng = random.Random(14)
    passage = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = passage + [f"w{rng.randrange(10**6)}" for _ in range(60 if i % 2 else 3)]
        rows.append((2 * i, " ".join(words)))
        words[130 if i % 2 else 50] = "v"
        rows.append((2 * i + 1, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want, given = components(sets, links), docs(rows)
    context = given.sparkSession.sparkContext
    context.setJobGroup(f"within {within}", "near-duplicates")
    try:
        got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(given).collect()}
    finally:
        context._jsc.clearJobGroup()
    assert got == want and len(set(want.values())) > 20
    assert within < 50_000 or len(context.statusTracker().getJobIdsForGroup(f"within {within}")) < 130


def test_descended_nodes_miss_no_pair_at_the_greatest_depth():
    """Each pair of different components of a node that does not branch meets in a block; a node of one component goes."""
    rep = np.arange(50)
    node, component = np.repeat([7, 9], [30, 20]), np.r_[np.repeat([0, 1, 2], [18, 8, 4]), np.full(20, 30)]
    sig = np.random.default_rng(1).integers(0, 2**32, (50, N.SIGNATURE), dtype=np.uint32)
    met = {}
    for found in N.descended(sig, rep, node, component, np.full(50, 10), 10, 8):
        for r, at, own, c in zip(*(x.tolist() for x in found), strict=True):
            assert own == 7 and c == component[r]
            met.setdefault(at, []).append(r)
    pairs = {(a, b) for rows in met.values() for a in rows for b in rows if a < b and component[a] != component[b]}
    assert pairs == {(a, b) for a in range(30) for b in range(30) if a < b and component[a] != component[b]}
