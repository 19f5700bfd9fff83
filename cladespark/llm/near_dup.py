"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

1. Each text becomes a set of shingle hashes and its sketch (sketch.py); only band keys and a digest of the set are
   kept. Equal sets are one class, named by its least doc_id.
2. Classes that share a band key are candidates. In each bucket the member with the most collisions over all bands is
   the hub; every member is compared with its hubs on the full sets. That links nearly all copies of a text to it
   with one pair a member, however large the bucket is.
3. Buckets whose members are not yet of one component are searched for the rest: small ones by a join, those of up to
   BLOCK members in one task each, from which only links come out. The members of larger ones meet again by their
   rarest shingles: two sets that share enough have one in common among the first few of each in any common order (the
   prefix filter), so nothing is lost, and texts that only share what very many have do not meet at all. The order is
   by how many of these sets hold a shingle, as a table of TABLE counters tells. Groups by rare shingle that are still of
   several components, each set of members once, are searched like buckets; what is larger than BLOCK even then, in
   pairs of blocks.
4. Links give components.

The bands follow the percentage from which texts are linked. With 24 bands of 6 coordinates, two texts of similarity 0.85
share no band with a probability of (1 - 0.85 ** 6) ** 24 = 1.2e-5; for 0.8 there are 28 bands of 5, and it is 1.5e-5.

Cases: null or empty text has no shingles and is linked with nothing; texts of any length are read whole; equal rows, also
of one doc_id, are one class; rows of one doc_id with different texts count as one document that has the links of all; a
row without doc_id joins a class but cannot name one; ties need no order, as all links count; an empty table gives an
empty one; extra columns, whatever their names, are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import materialized, maybe_among, table, with_made
from cladespark.llm.components import components
from cladespark.llm.sketch import Shingler, band_keys, banding, sketch

#: Percent of the union that two linked sets share at least, where a caller names no other.
PERCENT = 85
#: Groups of at most SMALL members are searched by a join, those of at most about BLOCK in one task.
SMALL, BLOCK = 8, 512
#: Counters that tell rare shingles from common ones (4 MB, whatever the size of the corpus).
TABLE = 1 << 20
KEYS = "n_shingles long, h1 long, h2 long, bands array<long>"


def sketched(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with n_shingles, a 128-bit digest of the shingle set (h1, h2) and its band keys (none for an empty set)."""
    bands, rows = banding(percent)

    def maker():
        shingles = Shingler()

        def one(text: str | None) -> tuple:
            own = shingles(text)
            if not len(own):
                return 0, 0, 0, []
            h1, h2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
            return len(own), int(h1), int(h2), band_keys(sketch(own), bands, rows).tolist()

        return lambda texts: [*zip(*map(one, texts))]

    return with_made(docs, text, KEYS, maker)


def shingle_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    def maker():
        shingles = Shingler()
        return lambda texts: [[shingles(t).view(np.int64) for t in texts]]

    return with_made(docs, text, "shingles array<long>", maker)


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the members of one block that look for links (seeks) and its others, of another component."""
    group = group.reset_index(drop=True)
    sizes = group["shingles"].map(len).to_numpy()
    owner, shingle = np.repeat(np.arange(len(group)), sizes), np.concatenate(group["shingles"].to_numpy())
    seeks, node, comp = group["seeks"].to_numpy(bool), group["node"].to_numpy(), group["component"].to_numpy()
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(shingle)]))
    out = []
    targets = np.flatnonzero(~seeks)
    for s in np.flatnonzero(seeks):
        mine = np.zeros(len(start), bool)
        mine[run[owner == s]] = True
        shared = np.bincount(owner[mine[run]], minlength=len(group))[targets]
        fits = (100 * shared >= percent * (sizes[targets] + sizes[s] - shared)) & (comp[targets] != comp[s])
        out += [(node[s], node[t]) for t in targets[fits]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def undecided(entries: DataFrame, first: DataFrame) -> DataFrame:
    """The entries (key, node, n) of keys whose nodes are of several components, with the component, m (nodes of the key), top (its
    largest component) and others (nodes outside of that)."""
    now = entries.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = now.groupBy("key", "component").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", -F.col("component"))).alias("top"))
    keys = keys.where(F.col("top.c") < F.col("m")).select("key", "m", (-F.col("top.col2")).alias("top"), (F.col("m") - F.col("top.c")).alias("others"))
    return now.join(keys, "key")


def joined(few: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key; for keys of few nodes."""
    a = few.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    b = few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & similar_sizes(F.col("na"), F.col("nb"), percent))
    return pairs.select("a", "b").distinct()


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """sets: node, shingles. For each node its rarest shingles, one of which any set that is similar enough shares: node, n, key."""
    slots = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(TABLE)).cast("int").alias("slot")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("c"))
    got = slots.toPandas()  # TABLE rows at most
    table = np.zeros(TABLE, np.int32)
    table[got["slot"]] = got["c"]
    counters = sets.sparkSession.sparkContext.broadcast(table)

    def maker():
        held = counters.value

        def first(own: list) -> list:
            h = np.array(own, np.int64)
            return h[np.lexsort((h, held[h % TABLE]))][: len(h) - (percent * len(h) + 99) // 100 + 1].tolist()

        return lambda rows: [[*map(first, rows)]]

    return with_made(sets, "shingles", "rare array<long>", maker).select("node", F.size("shingles").alias("n"), F.explode("rare").alias("key"))


def each_once(groups: DataFrame) -> DataFrame:
    """Of groups (key, node) with the same nodes one: a passage that texts share makes one for each of its shingles."""
    nodes = groups.groupBy("key").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    return groups.join(nodes.groupBy("c", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def remaining_links(entries: DataFrame, first: DataFrame, tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """entries: key, node, n; first: node, component so far; tried: pairs that were verified already."""
    buckets = materialized(undecided(entries, first), "open-buckets")
    crowd = materialized(buckets.where(F.col("m") > BLOCK).select("node").distinct(), "crowd")
    groups = buckets.where(F.col("m") <= BLOCK)
    if crowd.head(1):
        rare = materialized(rarest(materialized(sets.join(crowd, "node", "left_semi"), "crowd-sets"), percent), "rare-shingles")
        groups = materialized(groups.unionByName(each_once(materialized(undecided(rare, first), "open-groups"))), "groups")
    pairs = joined(groups.where(F.col("m") <= SMALL), percent).join(tried, ["a", "b"], "left_anti")

    many = groups.where(F.col("m") > SMALL)
    seekers = F.ceil(F.col("others") / BLOCK).cast("int")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    turn = F.xxhash64("node")
    of_seekers, of_blocks = F.pmod(turn, seekers.cast("long")).cast("int"), F.pmod(turn, blocks.cast("long")).cast("int")
    same = ["key", "node", "component"]
    seeking = many.where(F.col("component") != F.col("top")).select(*same, F.lit(True).alias("seeks"), of_seekers.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    others = many.select(*same, F.lit(False).alias("seeks"), of_blocks.alias("j"), F.explode(F.sequence(F.lit(0), seekers - 1)).alias("i"))
    placed = seeking.unionByName(others).join(sets, "node").groupBy("key", "i", "j").applyInPandas(lambda group: block_links(group, percent), "a long, b long")
    return verified(pairs, sets, percent).union(placed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Sets that share percent of their union or more are linked."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = materialized(sketched(docs, percent=percent).drop("text"), "sketches")
    classes = keyed.where(F.col("n_shingles") > 0).groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialized(classes, "classes")

    entries = classes.where(F.col("node").isNotNull()).select(F.explode("bands").alias("key"), "node", "n").distinct()
    sizes = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    entries = materialized(entries.join(sizes, "key"), "buckets")
    degrees = entries.groupBy("node").agg(F.sum("m").alias("degree"))
    hubs = entries.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), F.col("n").alias("hub_n"))).alias("h"))
    hubs = hubs.select("key", (-F.col("h.minus")).alias("hub"), "h.hub_n")
    pairs = entries.join(hubs, "key").where((F.col("node") != F.col("hub")) & similar_sizes(F.col("n"), F.col("hub_n"), percent))
    pairs = materialized(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")

    nodes = entries.select("node").distinct()
    sets = shingle_sets(maybe_among(docs.withColumnRenamed("doc_id", "node"), "node", nodes)).drop("text")
    sets = materialized(sets.join(nodes, "node", "left_semi"), "sets")
    links = materialized(verified(pairs, sets, percent), "links")
    more = materialized(remaining_links(entries.select("key", "node", "n"), components(links), pairs, sets, percent), "more-links")
    whole = components(links.union(more))

    named = classes.select("h1", "h2", "node").join(whole, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    got = keyed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    # rows without words keep to themselves
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return got.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLES: dict[str, str] = {}
