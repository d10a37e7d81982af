"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of k words (A-Z lower-cased); with fewer words the whole sequence is the
one member. Two documents are linked if their sets' Jaccard similarity is `percent` or more; a group is what links connect.

1. Each set gets `SIZE` minwise tokens. Documents with the same lower-cased words, by SHA-256, are one class (exact copies).
2. `TREES` trees branch documents by selected minwise tokens: a node is reached by agreeing in one token after another,
   the tokens of each step chosen by the tree. Branching begins `FIRST` tokens deep. Nodes of one class end there.
3. In the first `PIVOT_TREES` trees, each node's members are compared with its least id alone: linear, whatever the
   node's size, and enough to join nearly all of a group of near copies.
   In those with more than `SMALL` members that still hold several groups, `ROUNDS` times at most, each member is then
   compared with a central one (of a few drawn by hash, the one whose minwise tokens agree most with the others'), which
   again is linear and joins copies that the least id alone is too far from.
4. What that leaves apart is compared in all trees. A node in which all are in one group already needs nothing.
   Small nodes compare all pairs of different groups. The members of larger ones, unless one group has three quarters of
   them, go on to deeper trees, up to `LAST` tokens, which are more (`LEVELS`) as a pair meets less often there.
   What nodes with such a group, and those still large at the end, hold outside their main group
   is compared with all of that group and all else outside it, once for all nodes of the group, in blocks of some `BLOCK` sets and
   without making a row for each pair: an exact way for the rest, and nothing is capped.
5. A pair is compared by its minwise tokens first (dropped if they agree so little that a similar pair would do so less
   than once in 10^7), then by its sets of shingles in full, from the texts.
6. Groups come from alternating minimum propagation and pointer jumping over the links, in tables in the shared folder.

All trees draw from the same 128 tokens, so they are not independent: how many of these agree decides for all of them.
Averaged over the binomial number of agreements, a pair of similarity 0.8 meets in none of the trees with probability
4.6e-7 at depth 4 (40 trees), 2.4e-7 at depth 6 (100) and 4.6e-8 at depth 8 (300): with step 5, below `MISS` in all, however
large its nodes are. Recall is that target, not a proof.

Hot groups: exact copies are one row from step 1 on; near copies meet in hot nodes, whose rows are aggregated to a least
id before they are shuffled, and compared linearly.

Defined cases: null and wordless texts have an empty set, are linked with nothing and are groups of their own; null ids are
kept, each row a group of its own; rows that repeat an id count as one document if their sets are equal, and otherwise all
rows of an id share the group (its least member); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE, TREES, PIVOT_TREES, FIRST, LAST, SMALL, SEED = 128, 40, 6, 4, 8, 24, 20250
#: Trees by depth, so many that a pair of similarity 0.8 is missed with a probability below MISS.
LEVELS, MISS = {FIRST: TREES, 6: 100, LAST: 300}, 1e-6
_rng = np.random.default_rng(SEED)
_A = (_rng.integers(0, 2**32, SIZE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, SIZE, dtype=np.uint64).astype(np.uint32)
#: The tokens that each tree branches by, step by step.
PATHS = np.stack([_rng.permutation(SIZE)[:LAST] for _ in range(max(LEVELS.values()))])
#: A pair of similarity 0.8 agrees in fewer of 128 tokens with a probability below 1e-7.
AGREE = 77
BROADCAST_IDS = 2_000_000
#: Rounds of central members, and how many are drawn in a node to find one.
ROUNDS, DRAWN = 2, 32
#: Rows from which on a key is hot, and keys whose facts are broadcast in any case (some 20 MB).
HOT, BROADCAST_FACTS = 1_000, 500_000
#: Sets that a task holds while others are compared with them.
BLOCK = 512


def shingles(words: list[bytes], k: int, ids: common.WordIds) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    of = ids.array(words)
    h = common.windows(of, k)
    return np.unique(h) if len(h) else common.mixed(np.array([len(words)], np.uint64) + common.windows(of, len(words)))


def shingle_set(text: str, k: int) -> frozenset:
    """The set in full, for the last word on a pair."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def signature(h: np.ndarray) -> np.ndarray:
    """SIZE minwise tokens of a set of hashes, in stretches that stay in the cache."""
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        x = low[at : at + 512]
        y = _A[:, None] * x[None, :] + _B[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(1), out=out)
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("words_id", pa.binary()), ("tokens", pa.binary())])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, words_id (SHA-256 of the lower-cased words, null if there are none), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for b in batches:
            n, words_id, tokens = [], [], []
            for text in b.column(1):
                words = text.as_py().encode("utf-8", "replace").lower().split()
                h = shingles(words, k, ids)
                n.append(len(h))
                words_id.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                tokens.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(words_id, pa.binary()), pa.array(tokens, pa.binary())], schema=SIGNED)

    return common.map_rows(common.documents(docs), run, "doc_id long, n_shingles long, words_id binary, tokens binary")


def chained(tokens: np.ndarray, trees: range, depth: int) -> np.ndarray:
    """Node ids at a depth, one column a tree: a hash of the tree and of the tokens on the way."""
    out = np.empty((len(tokens), len(trees)), np.uint64)
    for j, t in enumerate(trees):
        h = np.full(len(tokens), t + 1, np.uint64)
        for step in PATHS[t][:depth]:
            h = common.mixed(h * np.uint64(0x9E3779B97F4A7C15) + tokens[:, step].astype(np.uint64))
        out[:, j] = h
    return out


def nodes(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """id, group, tree, node: the nodes at a depth that each class (id, group, tokens) is in."""
    schema = pa.schema([("id", pa.int64()), ("group", pa.int64()), ("nodes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                tokens = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(len(b), SIZE)
                keys = chained(tokens, range(trees), depth).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * trees, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], schema=schema)

    common.ship(classes.sparkSession)
    out = classes.select("id", "group", "tokens").mapInArrow(run, "id long, group long, nodes array<long>")
    return out.select("id", "group", F.posexplode("nodes").alias("tree", "node"))


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and minwise tokens allow the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    few = 0 if percent < 80 else AGREE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(len(b), SIZE) for i in (2, 3))
                at = pa.array((x == y).sum(1) >= few)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(at), b.column(1).filter(at)], schema=schema)

    a = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("tokens").alias("x"))
    b = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("tokens").alias("y"))
    both = pairs.join(a, "a").join(b, "b").where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; texts: id, text, one row an id."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != b:
                    last = b, shingle_set(y.as_py(), k)
                s, t = shingle_set(x.as_py(), k), last[1]
                both = len(s & t)
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(at), batch.column(1).filter(at)], schema=schema)

    pairs = common.cut(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = few(common.cut(wanted, "wanted"))
    texts = texts.join(wanted, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, group (its least member) of every id in links (a, b)."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = common.cut(both, "edges")
    label = common.cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "label")
    while True:
        # The least label among the neighbours, then the label's own label.
        seen = edges.join(label.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        step = label.join(seen, "id").select("id", F.least("group", "near").alias("group"), F.col("group").alias("was"))
        up = step.select(F.col("id").alias("group"), F.col("group").alias("top"))
        new = common.cut(step.join(up, "group", "left").select("id", F.least("group", "top").alias("group"), "was"), "label")
        changed = new.where("group <> was").limit(1).count()
        label = new.select("id", "group")
        if not changed:
            return label


def few(df: DataFrame) -> DataFrame:
    """df, a table of ids written before, to be broadcast if it has BROADCAST_IDS rows at most; either way, joins give the same rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def beside(rows: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with facts, which hold one row a key and `n`, the rows of that key.

    Facts of BROADCAST_FACTS keys at most are sent to the rows. Beyond that, so are those of keys with many rows: HOT at least, and so
    many that there are a million of them at most. The others are joined by shuffle. So no key's rows meet in one task.
    """
    facts = common.cut(facts, "facts")
    keys, total = facts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if keys <= BROADCAST_FACTS:
        return rows.join(F.broadcast(facts), key)
    hot = facts.where(F.col("n") >= max(HOT, total // 1_000_000))
    if not hot.limit(1).count():
        return rows.join(facts, key)
    cold = facts.where(F.col("n") < max(HOT, total // 1_000_000))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))


def pivot_pairs(classes: DataFrame) -> DataFrame:
    """Each member of a node of the first trees with the node's least id: (a, b), a > b."""
    at = nodes(classes, PIVOT_TREES, FIRST)
    least = at.groupBy("node").agg(F.min("id").alias("b"), F.max("id").alias("top"), F.count("*").alias("n")).where("b < top")
    return beside(at, least, ["node"]).where("id > b").select(F.col("id").alias("a"), "b").distinct()


def mixed_nodes(rows: DataFrame) -> DataFrame:
    """node, main (the group with most of its members), m (so many), n (all members) of the nodes with more than one group."""
    sizes = rows.groupBy("node", "group").agg(F.count("*").alias("m"))
    found = sizes.groupBy("node").agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("n"), F.count("*").alias("groups"))
    return found.where("groups > 1").drop("groups")


def central_pairs(rows: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Each member of a node with a central member of another group: (a, b), a > b."""
    schema = pa.schema([("node", pa.int64()), ("pivot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivots = []
            for m in b.column(1).to_pylist():
                m.sort(key=lambda x: x["id"])
                t = np.frombuffer(b"".join(x["tokens"] for x in m), np.uint32).reshape(len(m), SIZE)
                pivots.append(m[int(np.argmax([(t == x).sum() for x in t]))]["id"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pivots, pa.int64())], schema=schema)

    draw = Window.partitionBy("node").orderBy(F.xxhash64("id", F.lit(turn)), "id")
    drawn = rows.select("node", "id").withColumn("k", F.row_number().over(draw)).where(F.col("k") <= DRAWN).select("node", "id")
    drawn = drawn.join(classes.select("id", "tokens"), "id").groupBy("node").agg(F.collect_list(F.struct("id", "tokens")).alias("m"))
    pivots = common.map_rows(drawn, run, "node long, pivot long")
    sizes = rows.groupBy("node").agg(F.first("n").alias("n"))
    of = classes.select(F.col("id").alias("pivot"), F.col("group").alias("g"))
    at = beside(rows.select("node", "id", "group"), pivots.join(of, "pivot").join(sizes, "node"), ["node"]).where(F.col("group") != F.col("g"))
    return at.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()


def open_links(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different groups that meet in a node of any tree; classes: id, group, tokens, n_shingles."""

    def linked(pairs: DataFrame) -> DataFrame:
        return common.cut(confirmed(alike(pairs, classes, percent), texts, k, percent), "links")

    found, at = [], nodes(classes, PIVOT_TREES, FIRST)
    for turn in range(ROUNDS):
        large = common.cut(beside(at, mixed_nodes(at).where(F.col("n") > SMALL).select("node", "n"), ["node"]), "mixed")
        if not large.limit(1).count():
            break
        links = linked(central_pairs(large, classes, turn))
        if not links.limit(1).count():
            break
        found.append(links)
        of = classes.select("id", "group")
        ends = links.join(of.select(F.col("id").alias("a"), F.col("group").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("group").alias("y")), "b")
        ends = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a > b")
        # Groups that links join, each with its new least id: few, beside the rows of nodes.
        merged = few(components(ends).select(F.col("id").alias("group"), F.col("group").alias("joined")))
        classes = common.cut(classes.join(merged, "group", "left").withColumn("group", F.coalesce("joined", "group")).drop("joined"), "grouped")
        at = large.join(merged, "group", "left").select("node", "tree", "id", F.coalesce("joined", "group").alias("group"))

    pairs, apart, at = [], [], nodes(classes, TREES, FIRST)
    few_of_main = F.col("group") != F.col("main")
    for depth in LEVELS:
        is_small, is_open = F.col("n") <= SMALL, (F.col("n") > SMALL) & (4 * F.col("m") < 3 * F.col("n")) if depth < LAST else F.lit(False)
        # Of a large node with a main group, or at the end, only what stands outside that group is needed.
        mixed = common.cut(beside(at, mixed_nodes(at), ["node"]).where(is_small | is_open | few_of_main).select("node", "id", "group", "main", is_small.alias("small"), is_open.alias("open")), "mixed")
        pairs.append(all_pairs(mixed.where("small")))
        apart.append(mixed.where("not small and not open").select("main", "id"))
        on = mixed.where("open").select("id").distinct()
        if depth == LAST or not on.limit(1).count():
            break
        at = nodes(common.cut(classes.join(few(common.cut(on, "open")), "id", "left_semi"), "deeper"), LEVELS[depth + 2], depth + 2)
    out = pairs[0]
    for x in pairs[1:]:
        out = out.union(x)
    out = out.distinct()
    rest = apart[0]
    for x in apart[1:]:
        rest = rest.union(x)
    rest = common.cut(rest.distinct(), "apart")
    if rest.limit(1).count():
        out = alike(out, classes, percent).union(rest_pairs(rest, classes, texts, k, percent)).distinct()
        out = common.cut(confirmed(out, texts, k, percent), "links")
    else:
        out = linked(out)
    for x in found:
        out = out.union(x)
    return out


def all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different groups in nodes of at most SMALL members."""
    members = rows.groupBy("node").agg(F.collect_list(F.struct("id", "group")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["id"] > x["id"]) & (y["group"] != x["group"])), lambda y: F.struct(y["id"].alias("a"), x["id"].alias("b")))))
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


class Held:
    """Sets of hashes by what they hold: counts what each shares with another set."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = np.array(ids, np.int64), np.array([len(x) for x in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.of = of[order]
        self.keys, first = np.unique(h[order], return_index=True)
        self.ends = np.append(first, len(h))

    def like(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Ids of the sets that are similar enough to s."""
        if not len(self.keys) or not len(s):
            return self.ids[:0]
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        shared = np.zeros(len(self.ids), np.int64)
        for a, b in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True):
            shared[self.of[a:b]] += 1  # a set holds a hash once
        return self.ids[(shared > 0) & (100 * shared >= percent * (self.sizes + len(s) - shared))]


def rest_pairs(apart: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Similar pairs (a, b) by hashes of shingles; apart: main, id of what stands outside the main group of a large node.

    That is compared with the main group and all else that is apart from it. All of them are dealt out in blocks of some BLOCK
    sets, and those apart visit each block.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    hashed = pa.schema([("id", pa.int64()), ("set", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py().encode("utf-8", "replace").lower().split(), k, ids).tobytes() for t in b.column(1)], pa.binary())], schema=hashed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, own, held = None, [], [], None
        for b in batches:
            x, y = [], []
            for main, block, visits, i, raw in zip(*(b.column(j).to_pylist() for j in range(4)), b.column(4), strict=True):
                if at != (main, block):
                    at, ids, own, held = (main, block), [], [], None
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if not visits:
                    ids.append(i)
                    own.append(s.copy())
                    continue
                if held is None:
                    held, own = Held(ids, own), []
                near = held.like(s, percent)
                near = near[near != i]
                x += np.maximum(near, i).tolist()
                y += np.minimum(near, i).tolist()
            yield common.batch(schema, [x, y])

    mains = few(common.cut(apart.select(F.col("main").alias("group")).distinct(), "mains"))
    own = classes.join(mains, "group", "left_semi").select(F.col("group").alias("main"), "id", F.lit(False).alias("apart"))
    each = common.cut(own.union(apart.select("main", "id", F.lit(True).alias("apart"))), "rest")
    blocks = each.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    each = beside(each, blocks, ["main"])
    stay = each.select("main", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("visits"), "id")
    visit = each.where("apart").select("main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("visits"), "id")
    wanted = few(common.cut(each.select("id").distinct(), "wanted"))
    known = common.cut(common.map_rows(texts.join(wanted, "id", "left_semi").select("id", "text").dropDuplicates(["id"]), sets, "id long, set binary"), "sets")
    dealt = stay.union(visit).join(known, "id").select("main", "block", "visits", "id", "set")
    n = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "main", "block").sortWithinPartitions("main", "block", "visits", "id")
    return common.map_rows(dealt, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    with common.scope(docs.sparkSession) as s:
        return s.keep(_near_duplicates(docs, k, percent), "groups")


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    rows = common.cut(signed(docs, k), "signed")
    whole = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = common.cut(whole.groupBy("words_id").agg(F.min("doc_id").alias("id"), F.min("tokens").alias("tokens"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "classes")
    member = common.cut(beside(whole.select("doc_id", "words_id").distinct(), classes.select("words_id", "id", "n"), ["words_id"]).select("doc_id", "id"), "member")
    classes = classes.select("id", "tokens", "n_shingles")
    # An id with several texts ties their classes together.
    several = member.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top").select("doc_id", "b")
    ties = member.join(several, "doc_id").where("id > b").select(F.col("id").alias("a"), "b")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    first = confirmed(alike(pivot_pairs(classes.withColumn("group", F.col("id"))), classes, percent), texts, k, percent)
    first = common.cut(first.union(ties), "links")
    group = components(first)
    now = classes.join(group, "id", "left").select("id", F.coalesce("group", "id").alias("group"), "tokens", "n_shingles")
    now = common.cut(now, "grouped")
    second = open_links(now, texts, k, percent)
    if second.limit(1).count():
        group = components(first.union(second))
    of = member.groupBy("doc_id").agg(F.min("id").alias("id")).join(group, "id", "left").select("doc_id", F.coalesce("group", "id").alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are their group's least id; of rows that repeat an id, the least text's.

    Ids that go, and those that repeat, are broadcast while they are few (BROADCAST_IDS), else joined by shuffle.
    """
    with common.scope(docs.sparkSession) as s:
        found = near_duplicates(docs, k, percent)
        per = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
        per = s.keep(per.where((F.col("n") > 1) | (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_id"), (F.col("doc_id") == F.col("component_id")).alias("_stays")), "decided")
    send = F.broadcast if per.count() <= BROADCAST_IDS else lambda x: x
    gone = per.select("_id")
    single = docs.join(send(gone), docs["doc_id"] == gone["_id"], "left_anti")  # docs may have an _id of its own
    repeated = docs.select(F.struct("*").alias("doc")).join(send(per.where("_stays").select("_id")), F.col("doc.doc_id") == F.col("_id"), "left_semi")
    order = F.struct(F.coalesce(F.col("doc.text"), F.lit("")))
    return single.unionByName(repeated.groupBy("doc.doc_id").agg(F.min_by("doc", order).alias("doc")).select("doc.*"))
