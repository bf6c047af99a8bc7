"""Near duplicates by a chosen-path similarity join.

Each tree branches the texts by selected tokens: a text follows, from the root,
the token of its shingle set with the smallest hash under the path so far. Two
sets of similarity J share d choices with probability J^d. A node with few texts
is compared exhaustively, a larger one is branched again; independent trees
make up for the pairs that a tree parts. Every pair found is confirmed on the
full sets.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import EDGES_IN_TASK, connected_components, forget, map_batches, marks, perhaps_in, stored, words

DEPTH = 4
RECALL = 0.9999
SMALL_NODE = 32
BLOCK = 128
SKETCH_BITS = 64
# Pivots that a text is compared with before groups are known.
CLOSEST = 2


def trees_for(percent: int, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Trees that keep a pair at the very limit with probability ``recall``, even if all its nodes are branched to the end."""
    one = (percent / 100) ** depth
    return 1 if one >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-one)))


@functools.cache
def bits_apart(percent: int, miss: float = 1e-7) -> int:
    """Sketch bits by which a pair at the limit differs at most, but for a probability of ``miss``.

    A bit differs where the minimum hashes do and then half the time.
    """
    p, seen = (1 - percent / 100) / 2, 0.0
    for k in range(SKETCH_BITS):
        seen += math.comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k)
        if 1 - seen <= miss:
            return k
    return SKETCH_BITS


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text, A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; a null text
    or one without words has none.
    """
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(h) - width + 1)
    joined = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        joined = _mix(joined * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n])
    return np.unique(joined)


class PathSketch:
    """Choices along each tree's path, and a sketch of one bit for each of 64 minimum hashes."""

    def __init__(self, trees: int, depth: int = DEPTH, seed: int = 7):
        self.trees, self.depth = trees, depth
        self.odd = _odd(seed, trees * depth).reshape(depth, trees, 1)
        self.bits = _odd(seed + 1, SKETCH_BITS)[:, None]
        self.powers = np.uint64(1) << np.arange(SKETCH_BITS, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """(trees x depth path keys, sketch) of a non-empty set; blocks bound the memory of long ones."""
        block = 4096
        path = np.zeros((self.trees, 1), np.uint64)
        keys = np.empty((self.trees, self.depth), np.uint64)
        for level in range(self.depth):
            least = None
            for at in range(0, len(s), block):
                m = ((s[None, at : at + block] ^ path) * self.odd[level]).min(axis=1)
                least = m if least is None else np.minimum(least, m)
            # the seed of the next choice is the path so far, which the key names
            path = _mix(path + least[:, None])
            keys[:, level] = path[:, 0]
        least = None
        for at in range(0, len(s), block):
            m = (s[None, at : at + block] * self.bits).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        bits = (_mix(least) >> np.uint64(17)) & np.uint64(1)
        return keys, int((bits * self.powers).sum(dtype=np.uint64))


def sketches(documents: DataFrame, id_col: str, text: str, width: int, trees: int, depth: int) -> DataFrame:
    """(id, n_shingles, digest, sketch, paths): one map over the whole texts.

    ``digest`` names the set: equal for equal sets, null for an empty one.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketch = PathSketch(trees, depth)
        n, digest, bits, paths = [], [], [], []
        for t in batch.column(1).to_pylist():
            s = shingle_set(t, width)
            n.append(len(s))
            if len(s):
                keys, b = sketch(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(b - 2**64 if b >= 2**63 else b)
                paths.append(keys.astype(np.int64).ravel())
            else:
                digest.append(None)
                bits.append(None)
                paths.append(None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.int64()), pa.array(paths, pa.list_(pa.int64()))],
            ["id", "n_shingles", "digest", "sketch", "paths"],
        )

    return map_batches(
        documents.select(F.col(id_col).alias("id"), F.col(text).alias("t")),
        run,
        f"id {id_type}, n_shingles long, digest binary, sketch long, paths array<long>",
    )


def _may_link(n_a: Column, n_b: Column, s_a: Column, s_b: Column, percent: int) -> Column:
    """What every linked pair fulfils: sizes within the similarity, sketches close."""
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (F.bit_count(s_a.bitwiseXOR(s_b)) <= bits_apart(percent))


def candidates(
    classes: DataFrame, trees: int, depth: int, small_node: int, percent: int
) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Stored pairs (x, a, b, apart) of each class representative x with the pivots of its nodes and stored members of small nodes, by level; the nodes large to the end.

    The pivot is the member of the smallest hash, so that texts that meet again and again meet the same pivot.
    """
    nodes = classes.select(
        "id",
        F.col("n_shingles").alias("n"),
        F.col("sketch").alias("s"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("paths", t * depth + 1, depth))
        ).alias("tree", "path"),
    )
    stars, members = [], []
    for level in range(depth):
        nodes = nodes.withColumn("key", F.xxhash64("tree", F.element_at("path", level + 1)))
        sizes = nodes.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n", "s")).alias("p"))
        sizes = sizes.where(F.col("size") > 1).withColumnRenamed("key", "k")
        sized = stored(nodes.drop("tree").join(sizes, F.col("key") == F.col("k")).drop("k"))
        p = F.col("p")
        star = sized.where((F.col("id") != p["id"]) & _may_link(F.col("n"), p["n"], F.col("s"), p["s"], percent)).select(
            F.col("id").alias("x"), F.greatest("id", p["id"]).alias("a"), F.least("id", p["id"]).alias("b"),
            F.bit_count(F.col("s").bitwiseXOR(p["s"])).alias("apart"),
        )
        # what meets its pivot in several trees is kept so often: both readers take each pair once
        stars.append(stored(star))
        members.append(stored(sized.where(F.col("size") <= small_node).select("key", "id", "n", "s")))
        large = sized.where(F.col("size") > small_node)
        before, nodes = nodes, stored(large.select("id", "n", "s", "path", F.col("key").alias("tree"), "key"))
        forget(sized, *([before] if level else []))
    return stars, members, nodes


def _full_sets(ids: DataFrame, documents: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, items): the full shingle sets of the given ids, as sorted hashes."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width).astype(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    # most texts have no candidate partner: the bitmap keeps them out of the shuffle of the exact join
    texts = perhaps_in(documents.select(F.col(id_col).alias("id"), F.col(text).alias("t")), marks(ids)).join(ids, "id", "left_semi")
    return map_batches(texts, run, f"id {id_type}, items array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return stored(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _labelled(rows: DataFrame, groups: DataFrame, crowds: DataFrame, x: str) -> DataFrame:
    """Adds the component of ``x`` as ``c_<x>`` and its crowd, if it is in one, as ``w_<x>``."""
    named = groups.join(crowds, "id", "full_outer").select(
        F.col("id").alias(x), F.coalesce("component_id", "id").alias(f"c_{x}"), F.col("crowd").alias(f"w_{x}")
    )
    return rows.join(named, x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))


def _apart() -> Column:
    """Ends not yet in one component, nor in one crowd, which is compared as a whole."""
    return (F.col("c_a") != F.col("c_b")) & ~F.coalesce(F.col("w_a") == F.col("w_b"), F.lit(False))


def _across(stars: DataFrame, members: DataFrame, groups: DataFrame, crowds: DataFrame, percent: int) -> DataFrame:
    """The pairs of one node, be it as members of a small one or with the pivot, whose ends are still apart.

    Pairs inside a component join nothing and are never made.
    """
    stars = _labelled(_labelled(stars.select("a", "b").distinct(), groups, crowds, "a"), groups, crowds, "b")
    named = _labelled(members.withColumnRenamed("id", "a"), groups, crowds, "a")
    # a node of one component has no pair to compare
    mixed = named.groupBy("key").agg(F.min("c_a").alias("low"), F.max("c_a").alias("high")).where("low != high").select("key")
    named = stored(named.join(mixed, "key", "left_semi"))
    one, two = (
        named.select(F.col("key").alias(f"k_{x}"), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"), *[F.col(f"{c}_a").alias(f"{c}_{x}") for c in "cw"], F.col("a").alias(x))
        for x in "ab"
    )
    near = _may_link(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), percent)
    pairs = one.join(two, (F.col("k_a") == F.col("k_b")) & (F.col("a") > F.col("b")) & _apart() & near)
    found = stored(stars.where(_apart()).select("a", "b").unionByName(pairs.select("a", "b")).distinct())
    forget(named)
    return found


def block_links(one: list[np.ndarray], two: list[np.ndarray], c_one: list, c_two: list, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between two lists of sets that join their components into as few as all links would.

    Shared items are counted by matrix products over slices of the items, so
    memory is bounded; of the linked pairs only those that join are returned.
    """
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    items, where = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), np.concatenate(sizes))
    shared = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(items), 8192):
        here = (where >= at) & (where < at + 8192)
        m = np.zeros((len(one) + len(two), min(8192, len(items) - at)), np.float32)
        m[row[here], where[here] - at] = 1
        shared += m[: len(one)] @ m[len(one) :].T
    either = sizes[0][:, None] + sizes[1][None, :] - shared
    top: dict = {}

    def root(c):
        while top.get(c, c) != c:
            c = top[c]
        return c

    found = []
    for i, j in np.argwhere(100 * shared >= percent * either):
        a, b = root(c_one[i]), root(c_two[j])
        if a != b:
            top[max(a, b)] = min(a, b)
            found.append((int(i), int(j)))
    return found


def _crowd_links(members: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, block: int) -> DataFrame:
    """Links inside crowds: sets of texts that meet in nodes still large after the last level.

    The largest component of a crowd is its bulk. Each text outside the bulk is
    compared with all of the crowd, in pairs of blocks of about ``block`` texts.
    """
    label = members.join(groups, "id", "left").select("id", "crowd", F.coalesce("component_id", "id").alias("c"))
    parts = label.groupBy("crowd", "c").agg(F.count("*").alias("m"))
    bulk = parts.groupBy("crowd").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("size"))
    bulk = bulk.where(F.col("size") > F.col("top.m")).select(
        "crowd",
        F.col("top.c").alias("bulk"),
        F.ceil(F.col("size") / block).cast("int").alias("all_blocks"),
        F.ceil((F.col("size") - F.col("top.m")) / block).cast("int").alias("stray_blocks"),
    )
    label = label.join(bulk, "crowd")
    h = F.xxhash64("id")
    stray = label.where(F.col("c") != F.col("bulk")).select(
        "id", "c", "crowd", F.lit(0).alias("side"), F.pmod(h, F.col("stray_blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"),
    )
    rest = label.select(
        "id", "c", "crowd", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("i"), F.pmod(h, F.col("all_blocks")).cast("int").alias("j"),
    )
    id_type = members.schema["id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one, two = (frame[frame["side"] == side].sort_values("id") for side in (0, 1))
        links = []
        if len(one) and len(two):
            links = block_links(list(one["items"]), list(two["items"]), list(one["c"]), list(two["c"]), percent)
        a, b = one["id"].to_numpy(), two["id"].to_numpy()
        return pd.DataFrame([(max(a[i], b[j]), min(a[i], b[j])) for i, j in links], columns=["a", "b"])

    placed = stray.unionByName(rest).join(sets, "id")
    return placed.groupBy("crowd", "i", "j").applyInPandas(run, f"a {id_type}, b {id_type}")


def near_duplicates(
    documents: DataFrame,
    id_col: str = "document_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    trees: int | None = None,
    depth: int = DEPTH,
    small_node: int = SMALL_NODE,
    block: int = BLOCK,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): groups of texts of a watched collection that are nearly equal.

    Texts are linked when a hundred times the shared shingles is at least
    ``percent`` times the shingles of both; groups are what links connect,
    ``component_id`` is the smallest id of the group, and ``kept`` marks that
    member. Texts of equal sets are one class and are compared once, through the
    smallest id. A null or empty text has no shingle and stays by itself.
    Every row has its result: a row without an id has no ``component_id``, is
    linked with nothing and kept; rows of one id should hold one text, else one
    of its texts stands for the id in the search. An empty table gives an empty
    result. ``trees`` follows from ``percent`` by :func:`trees_for`: of pairs at
    the very limit one in ten thousand may be missed, closer ones practically
    never. Nodes crowded to the last level are compared exhaustively by blocks.
    """
    trees = trees_for(percent, depth) if trees is None else trees
    mine = stored(sketches(documents, id_col, text, width, trees, depth))
    named = mine.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    heads = stored(named.groupBy("digest").agg(F.min("id").alias("head")))
    classes = named.join(heads.select(F.col("head").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    levels, small, crowded = candidates(classes, trees, depth, small_node, percent)
    stars, members = (functools.reduce(DataFrame.unionByName, x) for x in (levels, small))
    # texts that share crowded nodes of any tree form one crowd
    in_node = crowded.select(F.col("id").alias("member"), F.col("key").alias("node"))
    node_head = in_node.groupBy("node").agg(F.min("member").alias("b"))
    crowds = stored(
        connected_components(in_node.join(node_head, "node").select(F.col("member").alias("a"), "b"), in_task=EDGES_IN_TASK).select(
            "id", F.col("component_id").alias("crowd")
        )
    )
    # the closest pivots of every text join most groups; after them only what lies across groups is compared
    closest = F.slice(F.array_sort(F.collect_set(F.struct("apart", "a", "b"))), 1, CLOSEST)
    best = stars.groupBy("x").agg(closest.alias("p")).select(F.explode("p").alias("p"))
    best = stored(best.select("p.a", "p.b").distinct())
    ends = best.select(F.col("a").alias("id")).union(best.select("b")).union(crowds.select("id")).distinct()
    sets = stored(_full_sets(ends, documents, id_col, text, width))
    links = _confirmed(best, sets, percent)
    groups = stored(connected_components(links, in_task=EDGES_IN_TASK))
    inside = stored(_crowd_links(crowds, sets, groups, percent, block))
    if inside.head(1):
        links = links.unionByName(inside)
        groups = stored(connected_components(links, in_task=EDGES_IN_TASK))
    apart = _across(stars, members, groups, crowds, percent)
    more = stored(_full_sets(apart.select(F.col("a").alias("id")).union(apart.select("b")).distinct(), documents, id_col, text, width))
    across = _confirmed(apart, more, percent)
    if across.head(1):
        links = links.unionByName(across)
        groups = stored(connected_components(links, in_task=EDGES_IN_TASK))
    named = (
        mine.select("id", "n_shingles", "digest")
        .join(heads, "digest", "left")
        .join(groups.select(F.col("id").alias("head"), "component_id"), "head", "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "head", "id"))
    result = stored(
        named.select(
            F.col("id").alias(id_col),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
    forget(mine, heads, *levels, *small, crowded, crowds, best, sets, inside, apart, more, across, links, groups)
    return result
