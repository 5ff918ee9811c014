"""MinHash near-duplicates by a chosen-path set similarity join (operator 8).

A document's set is its distinct 5-word shingles. Copies (equal sets) first become one class. TREES independent trees
then branch the classes: each node selects one or two of a class's minwise tokens (4/3 on average, 1 over the threshold),
and for each of them the class goes to a child that the token names. A node that is small enough is compared
exhaustively, any other branches again. At the threshold 0.75 a pair has one common child per node on average, and is
still together at depth d of a tree with probability q(d), where q(0) = 1 and q(d + 1) = q - 3/16 q^2: 0.81, 0.69, 0.60,
... 0.32 at depth 10. All trees miss it with (1 - q(d)) ** TREES: 7e-11, 8e-8, 3e-6 at depths 1 to 3, 4e-3 at depth 10.

Large nodes are of two kinds: many documents that share a passage, which branch apart, and sets that are much alike, which
don't. So nodes that are large at the first level are first compared in chunks, each with the node's smallest class beside
its own members. This is linear work and joins what is alike. From then on only pairs of different components count:
where all but a few classes of a node are one component, these few are compared with all, in blocks, which is linear too;
any other node branches further. A node that is still large at the greatest depth is compared in blocks, missing nothing.
Nodes of up to WITHIN classes do all of this in one task each; only larger ones branch by rounds of shuffles.

Signatures only select who is compared; every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, cut, gathered, integral, join_counted, lean, mix, ngram_hashes, only_ids, settle, slices, word_hashes

WORDS, TREES, DEPTH = 5, 14, 10
#: Classes in a node, or outside its largest component, that are compared exhaustively; above it the node branches further.
NODE = 800
#: Classes in a large node that one task branches down to its leaves (some 300 bytes each); larger ones take a round of shuffles for each level.
WITHIN = 50_000
#: Rows that it sends on at a time.
SENT = 200_000
#: Trees whose large nodes are compared in chunks: a group of alike sets is large in nearly all trees, and few join it.
CHUNKED = 5
#: Share of nodes that select two tokens and not one: 4 / 3 tokens a node.
TWO = 1 / 3
#: Least share of equal signature positions for a pair to be confirmed: 5.5 standard deviations below 0.75 at 64 positions.
LEAST = 0.45
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Minwise tokens that nodes select from.
SIGNATURE = 64
#: Odd multipliers of the minwise hash functions, from a fixed seed.
FACTORS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
#: Bits of a node's name that hold the tree, at the first level.
TREE = 15
#: Pairs whose signatures are compared at a time.
PAIRS = 100_000


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than WORDS make one shingle, no words none."""
    return np.unique(ngram_hashes(words, min(WORDS, len(words)))) if len(words) else words


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Upper halves of the minima of every hash function over each (non-empty) set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SIGNATURE), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, f in enumerate(FACTORS):
            out[:, k] = np.minimum.reduceat(flat * f, starts) >> np.uint64(32)
    return out


def _words(batch):
    """Batches -> lists of (id, words' hashes), a slice at a time."""
    cache = WordHashes()
    for ids, texts in slices(batch, ("_id", "_text"), "_text", 1_000_000):
        yield ids, [word_hashes(t, cache) for t in texts]


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, n_shingles, print (of the whole set; null if empty), sig, short (its lower halves): one narrow pass over whole texts."""

    def run(batches):
        for ids, words in _words(batches):
            sets = [shingle_hashes(w) for w in words]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signature([sets[i] for i in full]) if full else []
            prints, sigs, shorts = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, sig, strict=True):
                prints[i], sigs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row.tobytes()
                shorts[i] = row.astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, sigs, shorts))], names=["_id", "n_shingles", "print", "sig", "short"]
            )

    source = docs.select(integral(docs, key).alias("_id"), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(lean(run), "_id long, n_shingles long, print binary, sig binary, short binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)


def children(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the nodes to which classes of these signatures go from the nodes they are in."""
    seed = mix(node)
    rows, out = [], []
    position = (seed >> np.uint64(40)) % np.uint64(SIGNATURE)
    other = (position + np.uint64(1) + (seed >> np.uint64(20)) % np.uint64(SIGNATURE - 1)) % np.uint64(SIGNATURE)
    for selected, some in ((position, np.ones(len(node), dtype=bool)), (other, (seed & np.uint64(0xFFFFF)) < np.uint64(TWO * (1 << 20)))):
        row = np.flatnonzero(some)
        at = selected[row]
        with np.errstate(over="ignore"):
            out.append(mix(node[row] * np.uint64(0x9E3779B97F4A7C15) + (at << np.uint64(32)) + sig[row, at.astype(np.int64)]))
        rows.append(row)
    return np.concatenate(rows), np.concatenate(out)


def _roots(batches):
    """Rows (rep, sig) -> (rep, node): the children of all roots."""
    for batch in batches:
        sig = _signatures(batch.column("sig"))
        for tree in range(TREES):
            row, node = children(sig, np.full(len(sig), tree + 1, dtype=np.uint64))
            node = node & ~np.uint64(TREE) | np.uint64(tree)  # the first level's nodes tell their tree
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), pa.array(node.view(np.int64))], names=["rep", "node"])


def _branches(batches):
    """Rows (rep, sig, node, component) -> (rep, node, component): the children."""
    for batch in batches:
        row, node = children(_signatures(batch.column("sig")), batch.column("node").to_numpy().view(np.uint64))
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(row), pa.array(node.view(np.int64)), batch.column("component").take(row)], names=["rep", "node", "component"])


def sized(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of made (with rep and node) of small nodes of at least two classes, and those of large ones, with the number n of classes."""
    sizes = gathered(cut(made.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")))
    made = gathered(cut(join_counted(made, sizes, "node")))
    return made.where(F.col("n") <= NODE), made.where(F.col("n") > NODE)


def chunks(large: DataFrame) -> DataFrame:
    """(rep, node, own): the first level's large nodes of CHUNKED trees in chunks of about NODE classes, the smallest class of each beside the others."""
    large = large.where(F.col("node").bitwiseAND(TREE) < CHUNKED)
    first = gathered(cut(large.groupBy("node").agg(F.min("rep").alias("first"), F.first("n").alias("n"))))
    number = lambda n: F.ceil(n / NODE).cast("int")
    name = lambda node, chunk: F.xxhash64(node, chunk)
    members = join_counted(large.drop("n"), first, "node").where("rep <> first")
    members = members.select("rep", name(F.col("node"), F.pmod(F.xxhash64("rep"), number(F.col("n"))).cast("int")).alias("at"), F.col("node").alias("own"))
    ahead = first.select(F.col("first").alias("rep"), F.explode(F.sequence(F.lit(0), number(F.col("n")) - 1)).alias("chunk"), "node")
    return members.unionByName(ahead.select("rep", name(F.col("node"), F.col("chunk")).alias("at"), F.col("node").alias("own"))).withColumnRenamed("at", "node")


def with_components(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Adds the component of each class, its own where it has no link."""
    found = rows.join(components.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    return found.withColumn("component", F.coalesce("component_id", "rep")).drop("component_id")


def mixed(large: DataFrame) -> DataFrame:
    """(rep, node, component, n, main, c): rows (rep, node, component) of nodes of several components; the largest one is `main` with c classes."""
    sizes = large.groupBy("node", "component").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("node").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("n"))
    sizes = cut(sizes.select("node", "n", F.col("main.component").alias("main"), F.col("main.c").alias("c")).where("n > c"))
    return cut(join_counted(large.select("rep", "node", "component"), sizes, "node"))


def blocks(rows: DataFrame) -> DataFrame:
    """(rep, node, own, component): nodes of `mixed` in pairs of blocks; those of the largest component meet the others' only."""
    half = F.lit(NODE / 2)
    rows = rows.withColumn("others", F.ceil((F.col("n") - F.col("c")) / half).cast("int")).withColumn("mains", F.ceil(F.col("c") / half).cast("int"))
    inside = F.col("component") == F.col("main")
    mine = F.when(inside, F.col("others") + F.pmod(F.xxhash64("rep"), "mains")).otherwise(F.pmod(F.xxhash64("rep"), "others")).cast("int")
    last = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = rows.withColumn("b", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    return rows.select("rep", F.xxhash64("node", F.least("b", "other"), F.greatest("b", "other")).alias("at"), F.col("node").alias("own"), "component").withColumnRenamed("at", "node")


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    other = np.zeros(len(sorted_columns[0]), dtype=bool)
    other[:1] = True
    for c in sorted_columns:
        other[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(other)


def _shares(node: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, c, main) of each row: its node's classes, those of the node's largest component, and that component; `mixed` in a task."""
    order = np.lexsort((component, node))
    node, component = node[order], component[order]
    runs = _starts(node, component)  # a node's component each
    count = np.diff(np.r_[runs, len(node)])
    nodes = _starts(node[runs])
    of = np.repeat(np.arange(len(nodes)), np.diff(np.r_[nodes, len(runs)]))
    n, c = np.add.reduceat(count, nodes), np.maximum.reduceat(count, nodes)
    largest = np.flatnonzero(count == c[of])
    main = component[runs[largest[_starts(of[largest])]]]
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.repeat(of, count)
    return n[at], c[at], main[at]


def _blocks(rep: np.ndarray, node: np.ndarray, component: np.ndarray, n: np.ndarray, c: np.ndarray, main: np.ndarray, half: int):
    """`blocks` in a task: lists of (rep, node, own, component), about SENT rows at a time."""
    others, mains, inside = -(-(n - c) // half), -(-c // half), component == main
    h = mix(rep.view(np.uint64))
    mine = np.where(inside, others + (h % mains.astype(np.uint64)).astype(np.int64), (h % others.astype(np.uint64)).astype(np.int64))
    last = np.where(inside, others, others + mains)
    upto, at = np.cumsum(last), 0
    while at < len(rep):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SENT, side="right")))
        k = last[at:to]
        row = np.repeat(np.arange(at, to), k)
        other = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
        with np.errstate(over="ignore"):
            name = mix(mix(node[row].view(np.uint64)) + ((low << 32) + high).astype(np.uint64))
        yield rep[row], name.view(np.int64), node[row], component[row]
        at = to


def descended(sig: np.ndarray, rep: np.ndarray, node: np.ndarray, component: np.ndarray, depth: np.ndarray, deepest: int, most: int):
    """Lists of (rep, node, own, component): whole nodes, each at its depth, branched to the leaves and blocks that compare them.

    The same as the rounds of `links` do: nodes of one component go, those of few classes beside it end in blocks, as all do at
    the greatest depth, and the others branch.
    """
    row = np.arange(len(rep))  # of sig and rep
    while len(row):
        n, c, main = _shares(node, component)
        ends = ((n - c <= most // 2) | (depth >= deepest)) & (n > c)
        if ends.any():
            yield from _blocks(rep[row[ends]], node[ends], component[ends], n[ends], c[ends], main[ends], most // 2)
        rest = (n > c) & ~ends
        row, node, component, depth = row[rest], node[rest], component[rest], depth[rest]
        if not len(row):
            return
        at, child = children(sig[row], node.view(np.uint64))
        row, node, component, depth = row[at], child.view(np.int64), component[at], depth[at] + 1
        n, c, _ = _shares(node, component)
        small = (n > c) & (n <= most)
        if small.any():
            yield rep[row[small]], node[small], node[small], component[small]
        row, node, component, depth = (x[n > most] for x in (row, node, component, depth))


def descent(deepest: int, most: int):
    """A function for mapInArrow: sorted rows (rep, sig, node, component, depth) -> (rep, node, own, component); see `descended`."""

    def run(batches):
        for table in grouped(batches):
            table = table.combine_chunks()
            of = [table.column(x).to_numpy() for x in ("rep", "node", "component", "depth")]
            sig = _signatures(table.column("sig"))
            for made in descended(sig, *of, deepest, most):
                for at in range(0, len(made[0]), SENT):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + SENT], pa.int64()) for x in made], names=["rep", "node", "own", "component"])

    return run


def grouped(batches, column: str = "node"):
    """Sorted Arrow batches -> tables that each hold whole groups, by streaming: at most one group is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(keys != keys[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if held and held[0].column(column)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(node: np.ndarray):
    """Index pairs of rows in the same group of a sorted column, in chunks."""
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    ends = np.r_[starts[1:], len(node)]
    left = np.repeat(ends, ends - starts) - np.arange(len(node)) - 1  # later rows of the group, for each row
    at = 0
    total = np.cumsum(left)
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        n = left[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _likely(table: pa.Table):
    """(i, j, likeness) of the rows that a table of nodes has to confirm: alike enough, not joined yet, and not together in a leaf that comes before."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, SIGNATURE)
    size = table.column("n_shingles").to_numpy()
    own = table.column("own").to_numpy()
    component = table.column("component").to_numpy()
    lists = table.column("leaves").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    leaf = np.full((len(sig), max(1, n.max(initial=0))), np.iinfo(np.int64).max)
    leaf[np.repeat(np.arange(len(sig)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    for i, j in _pairs(table.column("node").to_numpy()):
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        keep = (small * 100 >= large * PERCENT) & (component[i] != component[j])
        i, j = i[keep], j[keep]
        like = (sig[i] == sig[j]).mean(axis=1)
        keep = like >= LEAST
        i, j, like = i[keep], j[keep], like[keep]
        step = max(1, 50 * PAIRS // leaf.shape[1] ** 2)
        for at in range(0, len(i), step):  # of the leaves that both are in, the least compares them
            s = slice(at, at + step)
            x, y = leaf[i[s]], leaf[j[s]]
            both = (x[:, :, None] == y[:, None, :]) & (x < own[i[s]][:, None])[:, :, None]
            first = ~both.any(axis=(1, 2))
            yield i[s][first], j[s][first], like[s][first]


NODES = "rep long, node long, own long, component long, n_shingles long, sig binary, leaves array<long>"


def _select(batches):
    """Rows of nodes that take part in a pair to be confirmed there."""
    for table in grouped(batches):
        used = np.zeros(len(table), dtype=bool)
        for i, j, _ in _likely(table):
            used[i] = used[j] = True
        if used.any():
            yield from table.filter(pa.array(used)).combine_chunks().to_batches()


def _confirm(batches):
    """Links of each node, confirmed on full sets; pairs that confirmed links join already are skipped, so links stay linear in the rows."""
    for table in grouped(batches):
        reps, sets = table.column("rep").to_numpy(), table.column("set")
        full: dict[int, np.ndarray] = {}

        def of(i, full=full, sets=sets):
            if i not in full:
                full[i] = np.frombuffer(sets[i].as_buffer(), dtype=np.uint64)
            return full[i]

        root = list(range(len(reps)))

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = [np.concatenate(x) for x in zip(*_likely(table), strict=True)]
        for p in np.argsort(-found[2], kind="stable").tolist() if found else []:
            i, j = int(found[0][p]), int(found[1][p])
            a, b = find(i), find(j)
            if a == b:
                continue
            x, y = of(i), of(j)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= PERCENT * (len(both) - shared):
                low, high = (a, b) if reps[a] < reps[b] else (b, a)
                root[high] = low
        links = [(reps[i], reps[r]) for i in range(len(reps)) if (r := find(i)) != i]  # each to the smallest it is joined to
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])


def links(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): confirmed links between classes that span the components; classes has rep, n_shingles, sig."""
    source = docs.select(integral(docs, key).alias("_id"), F.col(text).cast("string").alias("_text"))
    small, large = sized(classes.select("rep", "sig").mapInArrow(lean(_roots), "rep long, node long"))
    small = small.select("rep", "node")
    alone = F.col("rep").alias("component")  # no two joined yet
    rows = small.select("rep", "node", F.col("node").alias("own"), alone)
    some = large.limit(1).count()
    if some:
        # a leaf compares all its pairs, a chunk doesn't: pairs of a chunk are left to leaves, whatever the leaf's name
        rows = rows.unionByName(chunks(large).select("rep", "node", F.lit(np.iinfo(np.int64).max).alias("own"), alone))
    found = cut(_links(source, classes, rows, small))
    if not some:
        return found
    components = settle(cut(connected_components(found)))
    large, rows, within = gathered(cut(with_components(large.select("rep", "node", "n"), components))), None, None
    for depth in range(1, DEPTH + 1):
        some = large.where(F.col("n") <= WITHIN).select("rep", "node", "component", F.lit(depth).cast("long").alias("depth"))
        within, large = some if within is None else within.unionByName(some), large.where(F.col("n") > WITHIN)
        if not large.limit(1).count():
            break
        nodes = mixed(large)
        ends = (F.col("n") - F.col("c") <= NODE // 2) | F.lit(depth == DEPTH)
        more = blocks(nodes.where(ends))
        rows = more if rows is None else rows.unionByName(more)
        rest = nodes.where(~ends).select("rep", "node", "component")
        if not rest.limit(1).count():
            break
        made = rest.join(classes.select("rep", "sig"), "rep").select("rep", "sig", "node", "component")
        small, large = sized(cut(made.mapInArrow(lean(_branches), "rep long, node long, component long")))
        rows = rows.unionByName(small.select("rep", "node", F.col("node").alias("own"), "component"))
        settle(found)
    within = within.join(classes.select("rep", "sig"), "rep").select("rep", "sig", "node", "component", "depth").repartition("node").sortWithinPartitions("node")
    made = within.mapInArrow(lean(descent(DEPTH, NODE)), "rep long, node long, own long, component long")
    rows = made if rows is None else rows.unionByName(made)
    more = settle(cut(_links(source, classes, rows)))
    # what the first round joined goes on as stars, which are soon contracted
    return components.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more)


def _links(source: DataFrame, classes: DataFrame, rows: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """(a, b) of rows (rep, node, own, component): pairs within a node.

    compared has the leaves (rep, node) that compare all their pairs: each pair is left to one of them. Without it a
    pair may be compared in several nodes, which costs little once what is alike has been joined.
    """
    none = F.array().cast("array<bigint>")
    if compared is None:
        rows = rows.withColumn("leaves", none)
    else:
        lists = compared.groupBy("rep").agg(F.collect_set("node").alias("leaves"))
        rows = rows.join(lists, "rep", "left").withColumn("leaves", F.coalesce("leaves", none))
    rows = rows.join(classes.select("rep", "n_shingles", F.col("short").alias("sig")), "rep")
    rows = rows.select("rep", "node", "own", "component", "n_shingles", "sig", "leaves").repartition("node").sortWithinPartitions("node")
    chosen = gathered(cut(rows.mapInArrow(lean(_select), NODES)))
    wanted = gathered(cut(chosen.select(F.col("rep").alias("_id")).distinct()))

    def sets(batches):
        for ids, words in _words(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingle_hashes(w).tobytes() for w in words], pa.binary())], names=["rep", "set"])

    full = only_ids(source, wanted, "_id").mapInArrow(lean(sets), "rep long, set binary")
    rows = chosen.join(full.hint("merge"), "rep").select("rep", "node", "own", "component", "n_shingles", "sig", "leaves", "set").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(lean(_confirm), "a long, b long")


def _own_texts(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): a key and the class of each of its texts, where it has several."""
    full = drawn.where("print IS NOT NULL AND _id IS NOT NULL")
    h = F.xxhash64("print")
    several = cut(full.groupBy("_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("_id"))
    return only_ids(full.select("_id", "print"), several, "_id").distinct().join(classes.select("print", "rep"), "print").select(F.col("_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links), kept (key = component_id), for each row of docs.

    Null and empty texts and texts without words have empty sets and link with nothing. Rows of a null key link with
    nothing, have a null component and are kept. Rows that repeat a key are one document, also if their texts differ:
    its links are those of all its texts, n_shingles is each row's own. Keys are integers, other types are refused.
    Texts of any length are read whole; other columns are not read, so their names can't clash; an empty table gives
    none. Copies of a third of the corpus are one class, found by a partial aggregation; all other work sees a class once.
    """
    drawn = cut(sketch(docs, key, text))
    classes = drawn.where("print IS NOT NULL AND _id IS NOT NULL").groupBy("print").agg(F.min("_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("short").alias("short"))
    classes = gathered(cut(classes))
    components = connected_components(links(docs, classes, key, text).unionByName(_own_texts(drawn, classes)))
    named = classes.select("print", "rep").join(components, F.col("rep") == F.col("id"), "left").select("print", F.coalesce("component_id", "rep").alias("component_id"))
    # rows without a set get prints of their own: null keys would meet in one task
    own = drawn.select("_id", "n_shingles", F.coalesce("print", F.concat(F.lit("none "), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")).alias("print"))
    out = own.join(named, "print", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose key is not the smallest of its component (see near_duplicates), with all columns.

    Rows of a null key stay, rows that repeat a key that stays do too. Dropped keys are broadcast only if counted small.
    """
    dropped = cut(near_duplicates(docs, key, text).where("NOT kept").select(key).distinct())
    return only_ids(docs, dropped, key, "left_anti")


def components_sql(alias: str = "documents") -> str:
    """DuckDB common table expressions for near_duplicates: `sets` (doc_id, n_shingles) and `reach` (doc_id, component_id)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {alias}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: list_aggregate(w[i:i + {WORDS} - 1], 'string_agg', ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
walk(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT walk.doc_id, linked.b FROM walk JOIN linked ON walk.other = linked.a),
reach AS (SELECT doc_id, min(other) AS component_id FROM walk GROUP BY doc_id)"""


def oracle() -> str:
    """DuckDB SQL for near_duplicates(documents)."""
    return f"WITH RECURSIVE {components_sql()} SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN reach USING (doc_id)"
