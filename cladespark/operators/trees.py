"""Forests as DataFrames: building them group by group, and relational operations on (tree, node, parent, len) rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.operators.distance import Metric
from cladespark.operators.kernels import NEAREST, neighbor_joining, path_lengths, place_all
from cladespark.sources.shared import discard, materialized

TREE = "node long, parent long, len double"


def edges_of(d: np.ndarray, algorithm: str) -> list[tuple[int, int, float]]:
    if algorithm == "nj":
        return neighbor_joining(d)
    return place_all(d, None if algorithm == "exact" else NEAREST)


#: Tips that go to Python at once: many small groups together.
ROWS = 2000


def _per_group(tips: DataFrame, group: str, columns: list[str], build: Callable[[pd.DataFrame], list], schema: str) -> DataFrame:
    """tips: a group column and ord. build: the rows of one group, in the order of ord -> the values of columns. Groups are dealt to
    buckets by a hash, so that small ones share a call of Python; a group is never split."""
    buckets = max(1, -(-tips.count() // ROWS))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([group, "ord"], ignore_index=True)
        codes = pd.factorize(rows[group], use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()
        made = []
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            part = build(rows.iloc[a:b].reset_index(drop=True))
            made.append([rows[group].iloc[[a] * len(part[0])].to_numpy(), *map(np.asarray, part)])
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip([group, *columns], zip(*made))})

    return tips.groupBy(F.pmod(F.xxhash64(group), F.lit(buckets)).alias("__bucket")).applyInPandas(run, f"{group} {tips.schema[group].dataType.simpleString()}, {schema}")


def build_trees(tips: DataFrame, group: str, metric: Metric, algorithm: str = "nj") -> DataFrame:
    """tips: a group column, ord (the order of placement), and what metric needs. One tree per group: group, node, parent, len.

    Nodes 0 .. n-1 are the tips in order; the root has no row. A group is one task's matrix, so groups must be small.
    algorithm: 'nj', 'exact' or 'k_closest'."""

    def build(rows: pd.DataFrame) -> list:
        edges = edges_of(metric(rows, rows), algorithm)
        return [[e[k] for e in edges] for k in range(3)]

    return _per_group(tips, group, ["node", "parent", "len"], build, TREE)


def tip_paths(tips: DataFrame, group: str, metric: Metric, algorithm: str = "nj") -> DataFrame:
    """Per tip of each group's tree: group, ord, first (path to the group's first tip), total (sum of paths to all tips), depth
    (path to the root)."""

    def paths(rows: pd.DataFrame) -> list:
        n, edges = len(rows), edges_of(metric(rows, rows), algorithm)
        root = max((p for _, p, _ in edges), default=0) if algorithm == "nj" else n if n > 1 else 0
        d = path_lengths(edges, [*range(n), *([root] if n > 1 else [])])
        return [rows["ord"], d[:n, 0], d[:n, :n].sum(axis=1), d[:n, -1] if n > 1 else [0.0]]

    return _per_group(tips, group, ["ord", "first", "total", "depth"], paths, "ord long, first double, total double, depth double")


def depths(tree: DataFrame, length: str = "len") -> DataFrame:
    """tree: node, parent (null at roots), len. Adds depth (edges from the root) and path (length from the root), by pointer doubling:
    each round doubles the stretch that every node looks up, so there are as many rounds as the depth has binary digits."""
    state = tree.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.coalesce(F.when(F.col("parent").isNotNull(), F.col(length)), F.lit(0.0)).alias("path"))
    while True:
        state = materialized(state, "ancestors")
        if not state.where("up IS NOT NULL").head(1):
            break
        above = state.select(F.col("node").alias("a"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("further"))
        rising = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("a"))
        rising = rising.select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("path") + F.col("further")).alias("path"))
        state = rising.unionByName(state.where("up IS NULL"))
    extra = state.select(F.col("node").alias("__node"), "depth", "path")
    return tree.drop("depth", "path").join(extra, F.col("node") == F.col("__node")).drop("__node")


#: How values of two sets of nodes become one: an aggregate, and the value of a node without any.
SUM, XOR, MAX = (F.sum, lambda a, b: a + b), (F.bit_xor, lambda a, b: a.bitwiseXOR(b)), (F.max, lambda a, b: F.greatest(a, b))


def subtree(tree: DataFrame, values: dict[str, tuple[Column, tuple]]) -> DataFrame:
    """values: column -> (value of a node, over columns of tree and is_leaf; SUM, XOR or MAX). Per node: node, parent, is_leaf and the
    values brought together over the node and all below it. After round k each node has those less than 2^k edges below; what the
    nodes 2^k below have is added, so rounds grow with the logarithm of the depth, and no node sends a row to each ancestor."""
    inner = tree.select(F.col("parent").alias("__p")).where("__p IS NOT NULL").distinct()
    marked = tree.join(inner, F.col("node") == F.col("__p"), "left").withColumn("is_leaf", F.col("__p").isNull())
    state = marked.select("node", F.col("parent").alias("up"), "parent", "is_leaf", *[v.alias(c) for c, (v, _) in values.items()])
    while True:
        state = materialized(state, "subtrees")
        if not state.where("up IS NOT NULL").head(1):
            break
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("__at")).agg(*[how[0](c).alias(f"__{c}") for c, (_, how) in values.items()])
        above = state.select(F.col("node").alias("__node"), F.col("up").alias("__next"))
        got = state.join(below, F.col("node") == F.col("__at"), "left").join(above, F.col("up") == F.col("__node"), "left")
        state = got.select("node", F.col("__next").alias("up"), "parent", "is_leaf", *[F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(how[1](F.col(c), F.col(f"__{c}"))).alias(c) for c, (_, how) in values.items()])
    return state.drop("up")


def along(tree: DataFrame, values: dict[str, tuple[Column, Callable[[Column, Column], Column]]]) -> DataFrame:
    """values: column -> (value of a node, how two become one: associative, and equal values may count twice). Per node: node, parent and
    the values brought together over the node and all above it, in as many rounds as the depth has binary digits."""
    state = tree.select("node", F.col("parent").alias("up"), "parent", *[v.alias(c) for c, (v, _) in values.items()])
    older = None
    while True:
        state = materialized(state, "along")
        if older is not None:
            discard(older)
        if not state.where("up IS NOT NULL").head(1):
            return state.drop("up")
        above = state.select(F.col("node").alias("__node"), F.col("up").alias("__next"), *[F.col(c).alias(f"__{c}") for c in values])
        got = state.join(above, F.col("up") == F.col("__node"), "left")
        older, state = state, got.select("node", F.col("__next").alias("up"), "parent", *[F.when(F.col("__node").isNull(), F.col(c)).otherwise(how(F.col(c), F.col(f"__{c}"))).alias(c) for c, (_, how) in values.items()])


def patristic(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """tree: node, parent (null at the root), len; pairs: a, b (nodes), and others. The pairs with lca (their lowest common ancestor), edges and
    d (the number and the length of the edges between them). Pairs with a node that is not in the tree are left out.

    A node is above another if its stretch of the preorder holds it. Each pair climbs from a by strides of halving length, as long as
    it stays below the common ancestor; the strides of each length are a table (ancestors of all nodes), so a climb is one equi-join
    for each binary digit of the depth."""
    sizes = subtree(tree, {"n": (F.lit(1).cast("long"), SUM)}).select(F.col("node").alias("__s"), F.col("n").alias("size"))
    info = depths(tree).join(preorder(tree).select(F.col("node").alias("__n"), "place"), F.col("node") == F.col("__n")).join(sizes, F.col("node") == F.col("__s"))
    info = materialized(info.select("node", "parent", "depth", "path", "place", (F.col("place") + F.col("size")).alias("end")), "nodes")
    spans = info.select(F.col("node").alias("__u"), F.col("place").alias("low"), F.col("end").alias("high"))
    strides, level = [], info.select("node", F.col("parent").alias("up"))
    while True:
        level = materialized(level.where("up IS NOT NULL").join(spans, F.col("up") == F.col("__u")).select("node", "up", "low", "high"), "strides")
        if not level.head(1):
            break
        strides.append(level)
        level = level.select("node", "up").join(level.select(F.col("node").alias("__node"), F.col("up").alias("__next")), F.col("up") == F.col("__node")).select("node", F.col("__next").alias("up"))
    of = lambda c: info.select(F.col("node").alias(f"__{c}"), *[F.col(v).alias(f"__{v}_{c}") for v in ("depth", "path", "place", "end")])
    state = pairs.join(of("a"), F.col("a") == F.col("__a")).join(of("b"), F.col("b") == F.col("__b")).withColumn("__x", F.col("a"))
    inside = lambda low, high: (F.col(low) <= F.col("__place_b")) & (F.col("__place_b") < F.col(high))
    for stride in reversed(strides):
        step = stride.select(F.col("node").alias("__at"), F.col("up").alias("__up"), "low", "high")
        got = state.join(step, F.col("__x") == F.col("__at"), "left")
        state = got.withColumn("__x", F.when(F.col("__up").isNotNull() & ~inside("low", "high"), F.col("__up")).otherwise(F.col("__x"))).drop("__at", "__up", "low", "high")
    over = info.select(F.col("node").alias("__at"), F.col("parent").alias("__over"))
    found = state.join(over, F.col("__x") == F.col("__at")).withColumn("lca", F.when(inside("__place_a", "__end_a"), F.col("a")).otherwise(F.col("__over")))
    top = info.select(F.col("node").alias("__l"), F.col("depth").alias("__deep"), F.col("path").alias("__far"))
    found = found.join(top, F.col("lca") == F.col("__l"))
    return found.select(*[F.col(f"`{c}`") for c in pairs.columns], "lca", (F.col("__depth_a") + F.col("__depth_b") - 2 * F.col("__deep")).alias("edges"), (F.col("__path_a") + F.col("__path_b") - 2 * F.col("__far")).alias("d"))


def edge_costs(tree: DataFrame, told: DataFrame) -> DataFrame:
    """tree: node, parent, len; told: query, leaf (a node of the tree), d. For every query and edge where the query would be put: query, node,
    parent, split (from the parent) and pendant; the least pendant is the best edge.

    The bound of a query at an end of an edge is the largest d - path over the leaves behind that end (0 at least). Below a node that is a
    largest d - depth; outside of it, leaves leave the way to the root at some ancestor, so it is a largest of ancestors. So
    there is one pass up (subtree) and one down (along), for all queries at once, however deep the tree is."""
    deep = materialized(depths(tree).select("node", "parent", F.coalesce("len", F.lit(0.0)).alias("len"), "path"), "deep")
    asked = told.select("query").distinct()
    sized = asked.join(deep, F.lit(True))  # every query meets every node: that is the result's size
    rows = sized.join(told.select(F.col("query").alias("__q"), F.col("leaf").alias("__leaf"), "d"), (F.col("query") == F.col("__q")) & (F.col("node") == F.col("__leaf")), "left")
    keyed = materialized(rows.select(F.struct("query", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("query", F.col("parent").alias("node"))).alias("parent"), "len", "path", (F.col("d") - F.col("path")).alias("own")), "queries-nodes")
    up = subtree(keyed, {"most": (F.col("own"), MAX)}).select(F.col("node").alias("__node"), "most")
    low = materialized(keyed.join(up, F.col("node") == F.col("__node")).drop("__node"), "lower-bounds")
    # the largest of the other children, and what the parent itself has
    best = low.where("parent IS NOT NULL").groupBy("parent").agg(F.max(F.struct("most", "node")).alias("first"), F.count("most").alias("n"))
    second = low.where("parent IS NOT NULL").join(best.select(F.col("parent").alias("__p"), F.col("first.node").alias("__top")), F.col("parent") == F.col("__p"))
    second = second.where(F.col("node") != F.col("__top")).groupBy(F.col("parent").alias("__s")).agg(F.max("most").alias("second"))
    over = low.select(F.col("node").alias("__o"), F.col("path").alias("over"), F.col("own").alias("over_own"))
    side = low.join(best.withColumnRenamed("parent", "__p"), F.col("parent") == F.col("__p"), "left").join(second, F.col("parent") == F.col("__s"), "left").join(over, F.col("parent") == F.col("__o"), "left")
    others = F.greatest(F.when(F.col("node") == F.col("first.node"), F.col("second")).otherwise(F.col("first.most")), F.col("over_own"))
    side = side.select("node", "parent", "len", "path", "most", "over", (others + 2 * F.col("over")).alias("beside"))
    far = along(side, {"beside": (F.col("beside"), lambda a, b: F.greatest(a, b))}).select(F.col("node").alias("__node"), F.col("beside").alias("outer"))
    both = side.join(far, F.col("node") == F.col("__node")).where("parent IS NOT NULL")
    a, b, length = F.greatest(F.coalesce(F.col("outer") - F.col("over"), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(F.col("most") + F.col("path"), F.lit(0.0)), F.lit(0.0)), F.col("len")
    bound = both.select("node", "parent", "len", a.alias("a"), b.alias("b")).withColumn("pendant", F.greatest(F.lit(0.0), (F.col("a") + F.col("b") - length) / 2))
    bound = bound.withColumns({end: F.greatest(F.lit(0.0), F.col(end) - F.col("pendant")) for end in ("a", "b")})
    for end in ("a", "b"):
        bound = bound.withColumn("more", F.greatest(F.lit(0.0), F.col(end) - length)).withColumn(end, F.col(end) - F.col("more")).withColumn("pendant", F.col("pendant") + F.col("more"))
    return bound.select("node.query", "node.node", F.col("parent.node").alias("parent"), (F.col("a") + (length - F.col("a") - F.col("b")) / 2).alias("split"), "pendant")


def leaf_counts(tree: DataFrame) -> DataFrame:
    """Per inner node: node, n_leaves, n_nodes (below it)."""
    got = subtree(tree, {"n_leaves": (F.col("is_leaf").cast("long"), SUM), "n_nodes": (F.lit(1).cast("long"), SUM)})
    return got.where("NOT is_leaf").select("node", "n_leaves", (F.col("n_nodes") - 1).alias("n_nodes"))


def leaf_depths(tree: DataFrame) -> DataFrame:
    """One row: n_leaves, most and mean depth of the leaves in edges and in length."""
    inner = tree.select(F.col("parent").alias("node")).distinct()
    leaves = depths(tree).join(inner, "node", "left_anti")
    return leaves.agg(F.count("*").alias("n_leaves"), F.max("depth").alias("most_edges"), F.avg("depth").alias("mean_edges"), F.max("path").alias("most_length"), F.avg("path").alias("mean_length"))


def preorder(tree: DataFrame) -> DataFrame:
    """node, place: where a walk from the root meets it (0 on), children in the order of their numbers. A node comes one after its
    parent and after all below its earlier siblings, so its place is a length of its path."""
    sizes = subtree(tree, {"n": (F.lit(1).cast("long"), SUM)})
    earlier = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    step = sizes.withColumn("len", (1 + F.coalesce(F.sum("n").over(earlier), F.lit(0))).cast("double")).select("node", "parent", "len")
    return depths(step).select("node", F.col("path").cast("long").alias("place"))


def splits(trees: DataFrame) -> DataFrame:
    """trees: tree, node, parent, leaf (what names a leaf in all trees; not looked at for inner nodes); node numbers may repeat between trees.
    The splits of the leaves that inner edges make, without regard to a root: tree, h1, h2 (a 128-bit digest of one side, the
    lesser of both), once each; and tree, n_leaves."""
    own = trees.select(F.struct("tree", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("tree", "parent")).alias("parent"), "leaf", "tree")
    own = own.select("node", F.when(F.col("parent").isNotNull(), F.struct(F.col("parent.tree").alias("tree"), F.col("parent.parent").alias("node"))).alias("parent"), "leaf", "tree")
    hashes = {f"h{k}": (F.when(F.col("is_leaf"), F.xxhash64("leaf", F.lit(k))).otherwise(F.lit(0).cast("long")), XOR) for k in (1, 2)}
    got = materialized(subtree(own, hashes | {"n": (F.col("is_leaf").cast("long"), SUM)}), "splits")
    roots = got.where("parent IS NULL").select(F.col("node.tree").alias("tree"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n").alias("n_leaves"))
    inner = got.where("parent IS NOT NULL").select(F.col("node.tree").alias("tree"), "h1", "h2", "n").join(roots, "tree").where((F.col("n") > 1) & (F.col("n") < F.col("n_leaves") - 1))
    side, other = F.struct("h1", "h2"), F.struct(F.col("h1").bitwiseXOR(F.col("r1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("r2")).alias("h2"))
    return inner.select("tree", F.least(side, other).alias("s")).select("tree", "s.h1", "s.h2").distinct()


def robinson_foulds(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: tree, node, parent, leaf. Per tree: n_a, n_b (inner splits of the unrooted trees), shared, rf (splits of one only) and nrf (rf as a
    share of n_a + n_b; 0 where there are none)."""
    x, y = splits(a).withColumn("w", F.lit(1)), splits(b).withColumn("w", F.lit(2))
    both = x.unionByName(y).groupBy("tree", "h1", "h2").agg(F.sum("w").alias("w"))
    per = both.groupBy("tree").agg(*[F.count(F.when(F.col("w").bitwiseAND(k) == k, 1)).alias(n) for n, k in (("n_a", 1), ("n_b", 2), ("shared", 3))])
    every = a.select("tree").union(b.select("tree")).distinct().join(per, "tree", "left").na.fill(0, ["n_a", "n_b", "shared"])
    rf = F.col("n_a") + F.col("n_b") - 2 * F.col("shared")
    return every.withColumn("rf", rf).withColumn("nrf", F.when(F.col("n_a") + F.col("n_b") > 0, F.col("rf") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0))


def clade_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: tree, clade (sorted array of leaves, one row per inner node). Per tree: n_a, n_b, shared, and rf, the clades of one only."""
    x, y = a.select("tree", "clade").distinct(), b.select("tree", "clade").distinct()
    both = x.withColumn("w", F.lit(1)).union(y.withColumn("w", F.lit(2))).groupBy("tree", "clade").agg(F.sum("w").alias("w"))
    per = both.groupBy("tree").agg(*[F.count(F.when(F.col("w").bitwiseAND(k) == k, 1)).alias(n) for n, k in (("n_a", 1), ("n_b", 2), ("shared", 3))])
    return per.withColumn("rf", F.col("n_a") + F.col("n_b") - 2 * F.col("shared"))


def prune(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """The tree without these leaves (one column) and without inner nodes that have no leaf left, whatever its depth."""
    gone = materialized(leaves.toDF("__leaf").distinct(), "gone")
    marked = tree.join(gone, F.col("node") == F.col("__leaf"), "left").withColumn("__out", F.col("__leaf").isNotNull()).drop("__leaf")
    alive = subtree(marked, {"n": ((F.col("is_leaf") & ~F.col("__out")).cast("long"), SUM)}).where("n > 0").select(F.col("node").alias("__alive"))
    return tree.join(alive, F.col("node") == F.col("__alive"), "left_semi")


def without_unary(tree: DataFrame) -> DataFrame:
    """tree: node, parent, len and others. Inner nodes with one child are taken out, and the lengths of their edges added up; so is a root
    with one child, whose place the next node that is a leaf or has several children takes."""
    single = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("__single")).count().where("count = 1").select("__single")
    single = materialized(single, "unary")
    # chains of such nodes: how far each looks up doubles in each round, until all look at a node that stays, or at nothing
    chain = tree.join(single, F.col("node") == F.col("__single"), "left_semi").select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), F.coalesce("len", F.lit(0.0))).alias("more"))
    while True:
        chain = materialized(chain, "chains")
        above = chain.select(F.col("node").alias("a"), F.col("up").alias("next"), F.col("more").alias("further"))
        got = chain.join(above, F.col("up") == F.col("a"), "left")
        if not got.where("a IS NOT NULL").head(1):
            break
        chain = got.select("node", F.when(F.col("a").isNotNull(), F.col("next")).otherwise(F.col("up")).alias("up"), F.when(F.col("a").isNotNull(), F.col("more") + F.col("further")).otherwise(F.col("more")).alias("more"))
    stay = tree.join(single, F.col("node") == F.col("__single"), "left_anti")
    got = stay.join(chain.select(F.col("node").alias("a"), "up", "more"), F.col("parent") == F.col("a"), "left")
    parent = F.when(F.col("a").isNull(), F.col("parent")).otherwise(F.col("up"))
    length = F.when(F.col("a").isNull(), F.col("len")).otherwise(F.col("len") + F.col("more"))  # null below a root that went
    return got.withColumn("__parent", parent).withColumn("len", F.when(F.col("__parent").isNotNull(), length)).withColumn("parent", F.col("__parent")).select(*tree.columns)


def sampled(tree: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The tree of n of its leaves, those of the least hash of seed and node, without nodes of one child."""
    inner = tree.select(F.col("parent").alias("__p")).where("__p IS NOT NULL").distinct()
    leaves = materialized(tree.join(inner, F.col("node") == F.col("__p"), "left_anti").select("node"), "leaves")
    kept = leaves.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(n)
    return without_unary(prune(tree, leaves.join(kept, "node", "left_anti")))


def rescaled(tree: DataFrame, by: float, least: float = 1e-7) -> DataFrame:
    """Lengths divided by `by`; missing and zero ones stay as they are, and those that are negative become `least`."""
    new = F.when(F.col("len") / by <= 0, F.lit(least)).otherwise(F.col("len") / by)
    return tree.withColumn("len", F.when(F.col("len") == 0, F.col("len")).otherwise(new))


def length_range(tree: DataFrame, *keys: str) -> DataFrame:
    """Per keys: n (nodes with a length), least, most and mean length, zeros left out of the last three."""
    real = F.when(F.col("len") != 0, F.col("len"))
    return tree.where("len IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min(real).alias("least"), F.max(real).alias("most"), F.avg(real).alias("mean"))
