"""The registered queries and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.functions.murmur import decimal_hash, murmur_hash
from cladespark.functions.nucleotides import nucleotides
from cladespark.operators import distance as D
from cladespark.operators import trees as T
from cladespark.operators.build import add_to_tree, build_tree
from cladespark.operators.placement import GIVEN, add_tips, place_tips
from cladespark.operators.sketch import kmer_table, mash_given, mash_search, sketches
from cladespark.sources.shared import materialized

K, SIZE, SITES = 15, 1000, 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- k-mers and sketches of the documents' nucleotide letters

SEQ = "SELECT doc_id AS seq_id, translate(regexp_replace(upper(text), '[^ACGTU]', '', 'g'), 'U', 'T') AS seq FROM documents"
KMERS = f"""seqs AS ({SEQ}),
pieces AS (SELECT seq_id, substr(seq, CAST(i AS BIGINT), {K}) AS f FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM seqs)),
kmers AS (SELECT seq_id, least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer FROM pieces)"""


def _hashed(source: str) -> str:
    """CTEs from `source` (kmer) to `hashed` (kmer, h: unsigned), for strings of 9 to 15 ASCII bytes."""
    m = "CAST(18446744073709551616 AS UHUGEINT)"
    mul = lambda x, c: f"(CAST({x} AS UHUGEINT) * CAST({c} AS UHUGEINT)) % {m}"
    rot = lambda x, r: f"(({x} * CAST({1 << r} AS UHUGEINT)) % {m} + {x} // CAST({1 << (64 - r)} AS UHUGEINT))"
    word = lambda a, b: " + ".join(f"CAST(ascii(substr(kmer, {a + i}, 1)) AS UHUGEINT) * CAST({1 << (8 * i)} AS UHUGEINT)" for i in range(b))
    fix = lambda x: f"xor({x}, {x} // CAST(8589934592 AS UHUGEINT))"
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    steps = [
        (f"{word(9, K - 8)} AS b", f"{word(1, 8)} AS a"),
        (f"{mul('b', c2)} AS b", f"{mul('a', c1)} AS a"),
        (f"{rot('b', 33)} AS b", f"{rot('a', 31)} AS a"),
        (f"{mul('b', c1)} AS b", f"{mul('a', c2)} AS a"),
        (f"xor(xor(b, CAST(42 AS UHUGEINT)), CAST({K} AS UHUGEINT)) AS b", f"xor(xor(a, CAST(42 AS UHUGEINT)), CAST({K} AS UHUGEINT)) AS a"),
        ("b", f"(a + b) % {m} AS a"),
        (f"(b + a) % {m} AS b", "a"),
        (f"{fix('b')} AS b", f"{fix('a')} AS a"),
        (f"{mul('b', 0xFF51AFD7ED558CCD)} AS b", f"{mul('a', 0xFF51AFD7ED558CCD)} AS a"),
        (f"{fix('b')} AS b", f"{fix('a')} AS a"),
        (f"{mul('b', 0xC4CEB9FE1A85EC53)} AS b", f"{mul('a', 0xC4CEB9FE1A85EC53)} AS a"),
        (f"{fix('b')} AS b", f"{fix('a')} AS a"),
    ]
    out, last = [], source
    for k, cols in enumerate(steps):
        out.append(f"m{k} AS (SELECT kmer, {', '.join(cols)} FROM {last})")
        last = f"m{k}"
    return ",\n".join([*out, f"hashed AS (SELECT kmer, (a + b) % {m} AS h FROM {last})"])


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), nucleotides(F.col("text")).alias("seq"))


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_table(sequences(spark, sf_dir), K)


def kmer_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_counts(spark, sf_dir).select("kmer", decimal_hash(murmur_hash("kmer")).alias("h"))


def bottom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sketches(sequences(spark, sf_dir), K, SIZE).withColumn("n_kept", F.size("sketch").cast("long"))
    return got.select("seq_id", "n_kmers", "n_kept", decimal_hash(F.get("sketch", F.lit(0))).alias("least"), decimal_hash(F.get("sketch", F.size("sketch") - 1)).alias("most"))


def mash_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every document whose id is divisible by 100, among all, by textbook sketches."""
    asked = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("seq_id"))
    return mash_search(asked, sequences(spark, sf_dir), K, SIZE, 5)


def mash_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the eight after it, by sketches with repetitions and filling."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    pairs = ids.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + 8)).alias("j")).join(ids.toDF("j"), "j", "left_semi")
    return _rounded(mash_given(pairs, sequences(spark, sf_dir), K, SIZE), "d")


SKETCH = f"""{KMERS}, distinct_kmers AS (SELECT DISTINCT kmer FROM kmers), {_hashed('distinct_kmers')},
ranked AS (SELECT seq_id, h, row_number() OVER (PARTITION BY seq_id ORDER BY h) AS r, count(*) OVER (PARTITION BY seq_id) AS n_kmers FROM kmers JOIN hashed USING (kmer)),
sketch AS (SELECT * FROM ranked WHERE r <= {SIZE})"""

MASH = f"""WITH {SKETCH},
held AS (SELECT seq_id, h, count(*) AS c FROM sketch GROUP BY ALL),
sizes AS (SELECT d.doc_id AS seq_id, coalesce(sum(c), 0) AS n FROM documents d LEFT JOIN held ON seq_id = d.doc_id GROUP BY d.doc_id),
filled AS (SELECT seq_id, h, c FROM held UNION ALL SELECT seq_id, 18446744073709551615::UHUGEINT, {SIZE} - n FROM sizes WHERE n < {SIZE}),
sides AS (SELECT x.seq_id AS i, y.seq_id AS j FROM sizes x JOIN sizes y ON y.seq_id > x.seq_id AND y.seq_id <= x.seq_id + 8),
merged AS (SELECT i, j, h, sum(p) AS p, sum(q) AS q FROM (
    SELECT i, j, h, c AS p, 0 AS q FROM sides JOIN filled ON seq_id = i UNION ALL SELECT i, j, h, 0, c FROM sides JOIN filled ON seq_id = j) GROUP BY i, j, h),
walked AS (SELECT i, j, p, q, coalesce(sum(CASE WHEN p > 0 THEN p ELSE q END) OVER (PARTITION BY i, j ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM merged),
shared AS (SELECT i, j, CAST(coalesce(sum(q) FILTER (p > 0 AND before < {SIZE}), 0) AS BIGINT) AS shared FROM walked GROUP BY i, j)
SELECT i, j, shared, round(least(1.0::DOUBLE, abs(ln(2 * (greatest(shared, 1) / {SIZE}.0::DOUBLE) / (1 + greatest(shared, 1) / {SIZE}.0::DOUBLE)) / {K})), 6) AS d FROM shared"""

#: All pairs of a query and a document, also those that share nothing; the place of a hash in the union is counted, not bounded.
NEIGHBORS = f"""WITH {KMERS}, distinct_kmers AS (SELECT DISTINCT kmer FROM kmers), {_hashed('distinct_kmers')},
once AS (SELECT DISTINCT seq_id, h FROM kmers JOIN hashed USING (kmer)),
sketch AS (SELECT seq_id, h FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY h) AS r FROM once) WHERE r <= {SIZE}),
pairs AS (SELECT x.doc_id AS i, y.doc_id AS j FROM documents x JOIN documents y ON x.doc_id <> y.doc_id WHERE x.doc_id % 100 = 0),
merged AS (SELECT i, j, h, count(*) AS c FROM (SELECT i, j, h FROM pairs JOIN sketch ON seq_id = i UNION ALL SELECT i, j, h FROM pairs JOIN sketch ON seq_id = j) GROUP BY i, j, h),
placed AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY h) AS r FROM merged),
counted AS (SELECT i, j, count(*) FILTER (c = 2) AS shared, count(*) AS n FROM placed WHERE r <= {SIZE} GROUP BY i, j),
scored AS (SELECT i, j, coalesce(shared, 0) AS shared,
  greatest(coalesce(shared, 0), 1) / (CASE WHEN coalesce(shared, 0) = 0 THEN {SIZE} ELSE n END)::DOUBLE AS s FROM pairs LEFT JOIN counted USING (i, j)),
measured AS (SELECT i, j, shared, round(least(1.0::DOUBLE, abs(ln(2 * s / (1 + s)) / {K})), 9) AS d FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM measured)
SELECT i, j, shared, d, rank FROM best WHERE rank <= 5"""


# --- alignments: the lines of an order as a family of sequences that follow from their keys


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aligned sequence per order line: a common ancestor with substitutions, and gaps, that follow from the part's key. Keys that
    are equal modulo 97 have the same sequence, so each of the 97 is made once and joined to its lines."""
    t = F.col("t")

    def base(i):
        r = (i * 7919 + t * 104729) % 97
        own = ((i * 48271 + 11) % 101) % 4
        at = F.when(r == 50, F.lit(4)).when(r < 8, (own + 1 + (i + t) % 3) % 4).otherwise(own)
        return F.substr(F.lit("ACGT-"), (at + 1).cast("int"), F.lit(1))

    sites = F.sequence(F.lit(0).cast("long"), F.lit(SITES - 1).cast("long"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("family"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_partkey") % 97).alias("t"))
    made = lines.select("t").distinct().select("t", F.array_join(F.transform(sites, base), "").alias("aln"))
    return lines.join(F.broadcast(made), "t").select("family", "ord", "aln")


def _distances(model: str, compat: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = D.pair_distances(alignments(spark, sf_dir), "family", model, compat)
        # undefined distances (identical sequences in the written form of two models) are null and marked
        real = F.coalesce(~F.isnan("d") & (F.abs("d") < 1e9), F.lit(False))
        return pairs.select("family", "i", "j", F.when(real, F.round("d", 6)).alias("d"), real.alias("defined"))

    return query


def _distance_sql(model: str, compat: bool = False) -> str:
    head = f"""WITH tips AS (SELECT l_orderkey AS family, CAST(l_linenumber AS BIGINT) AS ord, l_partkey % 97 AS t FROM lineitem),
kinds AS (SELECT DISTINCT a.t AS t1, b.t AS t2 FROM tips a JOIN tips b ON a.family = b.family AND a.ord < b.ord),
codes AS (SELECT t, i, CASE WHEN (i * 7919 + t * 104729) % 97 = 50 THEN 4 WHEN (i * 7919 + t * 104729) % 97 < 8
    THEN (((i * 48271 + 11) % 101) % 4 + 1 + (i + t) % 3) % 4 ELSE ((i * 48271 + 11) % 101) % 4 END AS c
    FROM (SELECT unnest(range(0, 97)) AS t) CROSS JOIN (SELECT unnest(range(0, {SITES})) AS i)),
sites AS (SELECT t1, t2, a.c AS x, b.c AS y FROM kinds JOIN codes a ON a.t = t1 JOIN codes b ON b.t = t2 AND b.i = a.i),
n AS (SELECT t1, t2, count(*) FILTER (x < 4 OR y < 4)::DOUBLE AS useful, count(*) FILTER (x < 4 AND x = y)::DOUBLE AS same,
  count(*) FILTER (x < 4 AND y < 4)::DOUBLE AS total,
  count(*) FILTER (x < 4 AND y < 4 AND x <> y AND x % 2 = y % 2)::DOUBLE AS ts, count(*) FILTER (x < 4 AND y < 4 AND x % 2 <> y % 2)::DOUBLE AS tv,
  {', '.join(f'(count(*) FILTER (x = {b} AND y < 4) + count(*) FILTER (y = {b} AND x < 4))::DOUBLE AS f{b}' for b in range(4))},
  {', '.join(f'count(*) FILTER ((x = {a} AND y = {b}) OR (x = {b} AND y = {a}))::DOUBLE AS n{a}{b}' for a in range(4) for b in range(a + 1, 4))},
  count(*) FILTER (x IN (1, 2) AND y < 4 AND x <> y)::DOUBLE AS g1d, count(*) FILTER (y IN (1, 2) AND x < 4 AND x <> y)::DOUBLE AS g2d,
  count(*) FILTER (x IN (1, 2) AND y < 4)::DOUBLE AS g1a, count(*) FILTER (y IN (1, 2) AND x < 4)::DOUBLE AS g2a
  FROM sites GROUP BY ALL),
r AS (SELECT *, 1 - same / useful AS p, ts / total AS tp, tv / total AS tq, (total - same) / total AS dd,
  f0 / (2 * total) AS q0, f1 / (2 * total) AS q1, f2 / (2 * total) AS q2, f3 / (2 * total) AS q3 FROM n)"""
    g = "d" if compat else "a"
    formula = {
        "p": "p",
        "jc": "-0.75 * ln(1 - p / 0.75)",
        "k2p": "-0.5 * ln((1 - 2 * tp - tq) * sqrt(1 - 2 * tq))",
        "jinnei": "0.5 * (1 / (1 - 2 * tp - tq) + 0.5 / (1 - 2 * tq) - 1.5)",
        "tamura": f"-c * ln(1 - tp / c - tq) - 0.5 * (1 - c) * ln(1 - 2 * tq)",
        "tn": "-b * ln(1 - dd / b)",
    }[model]
    zero = "CASE WHEN dd = 0 THEN 0.0::DOUBLE ELSE " if not compat and model in ("tn", "tamura") else "CASE WHEN dd = 0 THEN NULL ELSE " if model in ("tn", "tamura") else "CASE WHEN FALSE THEN NULL ELSE "
    if model == "tamura":
        c = f", (SELECT *, g1{g} / total AS g1, g2{g} / total AS g2 FROM r) AS z"
        source = f"(SELECT *, g1 + g2 - 2 * g1 * g2 AS c FROM (SELECT *, g1{g} / total AS g1, g2{g} / total AS g2 FROM r))"
    elif model == "tn":
        if compat:
            h = "0.5 * (n02 * q0 * q2 + n03 * q0 * q3 + n12 * q1 * q2 + n13 * q1 * q3)"
            b = "0.5 * (1 - q0 * q0 - q2 * q2 + dd * dd / nullif(h, 0))"
        else:
            h = " + ".join(f"CASE WHEN n{x}{y} = 0 THEN 0 ELSE n{x}{y} * n{x}{y} / (total * total) / (2 * q{x} * q{y}) END" for x in range(4) for y in range(x + 1, 4))
            b = "0.5 * (1 - q0 * q0 - q1 * q1 - q2 * q2 - q3 * q3 + dd * dd / nullif(h, 0))"
        source = f"(SELECT *, {b} AS b FROM (SELECT *, {h} AS h FROM r))"
    else:
        source = "r"
    return f"""{head}, v AS (SELECT t1, t2, round({zero}{formula} END, 6) AS d FROM {source})
SELECT family, i, j, CASE WHEN defined THEN d END AS d, defined
FROM (SELECT a.family, a.ord AS i, b.ord AS j, v.d, coalesce(NOT isnan(v.d) AND abs(v.d) < 1e9, FALSE) AS defined FROM tips a JOIN tips b ON a.family = b.family AND a.ord < b.ord JOIN v ON v.t1 = a.t AND v.t2 = b.t)"""


# --- trees: the orders of a customer as the tips of a tree with known path lengths

PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)"
STATUS = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END"
TIPS = f"""tips AS (SELECT o_custkey AS grp, o_orderkey AS ord, 0.01 * (1 + o_orderkey % 7) AS p, 0.02 * (1 + {PRIORITY} % 5 + {STATUS}) AS e, 0.03 * {STATUS} AS r,
  {STATUS} * 10 + {PRIORITY} AS inner_, {STATUS} AS outer_ FROM orders),
d AS (SELECT a.grp, a.ord AS i, b.ord AS j, CASE WHEN a.ord = b.ord THEN 0 ELSE a.p + b.p + CASE WHEN a.inner_ <> b.inner_ THEN a.e + b.e ELSE 0 END + CASE WHEN a.outer_ <> b.outer_ THEN a.r + b.r ELSE 0 END END AS d
  FROM tips a JOIN tips b ON a.grp = b.grp)"""


def order_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tip per order, in a tree of status, priority and order within each customer."""
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    priority = F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("ord"), (0.01 * (1 + F.col("o_orderkey") % 7)).alias("p"),
        (0.02 * (1 + priority % 5 + status)).alias("e"), (0.03 * status).alias("r"), (status * 10 + priority).alias("inner_"), status.cast("long").alias("outer_"),
    )


def nested_metric(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Path lengths between leaves of a tree of three levels: own edge p, and e and r where the inner or outer node differs."""
    x = {c: a[c].to_numpy()[:, None] for c in ("p", "e", "r", "inner_", "outer_", "ord")}
    y = {c: b[c].to_numpy()[None, :] for c in ("p", "e", "r", "inner_", "outer_", "ord")}
    d = x["p"] + y["p"] + (x["inner_"] != y["inner_"]) * (x["e"] + y["e"]) + (x["outer_"] != y["outer_"]) * (x["r"] + y["r"])
    return np.where(x["ord"] == y["ord"], 0.0, d)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def nj_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.tip_paths(order_tips(spark, sf_dir), "grp", nested_metric, "nj").drop("depth"), "first", "total")


def holed_metric(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """The path lengths without those of orders whose keys add up to a multiple of 5 (undefined) or of 7 (infinite)."""
    d, both = nested_metric(a, b), a["ord"].to_numpy()[:, None] + b["ord"].to_numpy()[None]
    return np.where(both % 5 == 0, np.nan, np.where(both % 7 == 0, np.inf, d))


def nj_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer what neighbor joining makes of distances with holes: nodes that have a parent, different ones of them, roots, and lengths
    that are no number."""
    tips = order_tips(spark, sf_dir)
    edges = materialized(T.build_trees(tips, "grp", holed_metric, "nj"), "holed-trees")
    per = edges.groupBy("grp").agg(F.count("*").alias("n_edges"), F.count_distinct("node").alias("n_children"), F.count(F.when(F.isnan("len") | F.col("len").isNull() | (F.abs("len") > 1e9), 1)).alias("n_bad"))
    roots = edges.select("grp", F.col("parent").alias("node")).distinct().join(edges.select("grp", "node"), ["grp", "node"], "left_anti").groupBy("grp").agg(F.count("*").alias("n_roots"))
    every = tips.groupBy("grp").agg(F.count("*").alias("n_tips"))
    return every.join(per, "grp", "left").join(roots, "grp", "left").na.fill(0)


def _placed(algorithm: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(T.tip_paths(order_tips(spark, sf_dir), "grp", nested_metric, algorithm), "first", "total", "depth")

    return query


PATHS = f"""WITH {TIPS}, f AS (SELECT grp, min(ord) AS a FROM tips GROUP BY grp), g AS (SELECT t.grp, min(t.ord) AS b FROM tips t JOIN f ON f.grp = t.grp AND t.ord > f.a GROUP BY t.grp),
s AS (SELECT d.grp, i AS ord, round((max(d) FILTER (j = a))::DOUBLE, 6) AS first, round(sum(d)::DOUBLE, 6) AS total,
  round(coalesce(greatest(max(d) FILTER (j = a), max(d) FILTER (j = b)) - max(ab) / 2, 0), 6) AS depth
  FROM d JOIN f ON f.grp = d.grp LEFT JOIN g ON g.grp = d.grp LEFT JOIN (SELECT d.grp, d AS ab FROM d JOIN f ON f.grp = d.grp JOIN g ON g.grp = d.grp WHERE i = a AND j = b) k ON k.grp = d.grp GROUP BY d.grp, i)"""


def order_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of orders of a customer, both ways, with a zero diagonal."""
    t = order_tips(spark, sf_dir)
    a = t.select("grp", *[F.col(c).alias(f"{c}1") for c in ("ord", "p", "e", "r", "inner_", "outer_")])
    b = t.select("grp", *[F.col(c).alias(f"{c}2") for c in ("ord", "p", "e", "r", "inner_", "outer_")])
    d = F.col("p1") + F.col("p2") + F.when(F.col("inner_1") != F.col("inner_2"), F.col("e1") + F.col("e2")).otherwise(0.0) + F.when(F.col("outer_1") != F.col("outer_2"), F.col("r1") + F.col("r2")).otherwise(0.0)
    half = a.join(b, "grp").where("ord1 < ord2").select("grp", F.col("ord1").alias("i"), F.col("ord2").alias("j"), d.alias("d"))
    return D.mirrored(half, ["grp"])


def row_sums_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.row_sums(order_distances(spark, sf_dir), ["grp"]), "u")


def nj_q_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.next_join(order_distances(spark, sf_dir), ["grp"]), "q", "blx", "bly")


Q_SQL = f"""WITH {TIPS}, u AS (SELECT grp, i, sum(d) AS u, count(*) AS n FROM d GROUP BY grp, i HAVING count(*) > 2),
q AS (SELECT d.grp, d.i, d.j, d.d, a.u AS ui, b.u AS uj, a.n, round(d.d - a.u / (a.n - 2) - b.u / (a.n - 2), 9) AS q FROM d JOIN u a ON a.grp = d.grp AND a.i = d.i JOIN u b ON b.grp = d.grp AND b.i = d.j WHERE d.i < d.j),
w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY q, i, j) AS k FROM q),
x AS (SELECT *, (d + (ui - uj) / (n - 2)) / 2 AS bx FROM w WHERE k = 1),
y AS (SELECT *, CASE WHEN bx < 0 THEN 0 ELSE bx END AS x0, CASE WHEN bx < 0 THEN d - bx + bx ELSE d - bx END AS y0 FROM x)
SELECT grp, i, j, round(q, 6) AS q, round(CASE WHEN y0 < 0 THEN x0 + y0 ELSE x0 END, 6) AS blx, round(CASE WHEN y0 < 0 THEN 0 ELSE y0 END, 6) AS bly FROM y"""


# --- one tree of all customers, by divide and conquer

CUSTOMERS = """tips AS (SELECT (c_custkey * 7919 % 104729) * 1000000000 + c_custkey AS ord, 0.01 * (1 + c_custkey % 7) AS p, 0.02 * (1 + c_nationkey % 5) AS e, 0.03 * (1 + n_regionkey) AS r,
  c_nationkey AS inner_, n_regionkey AS outer_ FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def customer_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select(
        (F.col("c_custkey") * 7919 % 104729 * 1_000_000_000 + F.col("c_custkey")).alias("ord"), (0.01 * (1 + F.col("c_custkey") % 7)).alias("p"), (0.02 * (1 + F.col("c_nationkey") % 5)).alias("e"),
        (0.03 * (1 + F.col("n_regionkey"))).alias("r"), F.col("c_nationkey").cast("long").alias("inner_"), F.col("n_regionkey").cast("long").alias("outer_"),
    )


#: Tips that agree in these are equally far from all others by nested_metric.
ALIKE = ("p", "e", "r", "inner_", "outer_")


def divide_and_conquer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each customer is from the root of the tree of all."""
    edges = materialized(place_tips(materialized(customer_tips(spark, sf_dir), "customer-tips"), nested_metric, alike=ALIKE), "customer-tree")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    tree = edges.unionByName(roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("len")))
    return _rounded(T.depths(tree).where("node >= 0").select(F.col("node").alias("ord"), F.col("path").alias("depth")), "depth")


DC_SQL = f"""WITH {CUSTOMERS}, k AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM tips),
a AS (SELECT * FROM k WHERE n = 1), b AS (SELECT * FROM k WHERE n = 2),
d AS (SELECT t.ord, CASE WHEN t.ord = a.ord THEN 0 ELSE t.p + a.p + CASE WHEN t.inner_ <> a.inner_ THEN t.e + a.e ELSE 0 END + CASE WHEN t.outer_ <> a.outer_ THEN t.r + a.r ELSE 0 END END AS da,
  CASE WHEN t.ord = b.ord THEN 0 ELSE t.p + b.p + CASE WHEN t.inner_ <> b.inner_ THEN t.e + b.e ELSE 0 END + CASE WHEN t.outer_ <> b.outer_ THEN t.r + b.r ELSE 0 END END AS db,
  a.p + b.p + CASE WHEN a.inner_ <> b.inner_ THEN a.e + b.e ELSE 0 END + CASE WHEN a.outer_ <> b.outer_ THEN a.r + b.r ELSE 0 END AS ab FROM tips t, a, b)
SELECT ord, round(greatest(da, db) - ab / 2, 6) AS depth FROM d"""


# --- trees of sequences: documents by their sketches, parts by alignments


def part_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aligned sequence per part: substitutions of its family of brands, its brand and its own on a common ancestor, and gaps."""
    none = F.lit(4)

    def base(i):
        own = (i * 48271 + 11) % 101 % 4
        for key, rate, factor in ((F.col("m"), 12, 7919), (F.col("b"), 8, 15485), (F.col("p"), 4, 32452)):
            r = (i * factor + key * 104729) % 97
            own = F.when(r < rate, (own + 1 + (i + key) % 3) % 4).otherwise(own)
        return F.substr(F.lit("ACGT-"), (F.when((i * 271 + F.col("p") * 31) % 89 == 0, none).otherwise(own) + 1).cast("int"), F.lit(1))

    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ord"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.floor(brand / 10).alias("m"), brand.alias("b"), F.col("p_partkey").cast("long").alias("p"))
    sites = F.sequence(F.lit(0).cast("long"), F.lit(4 * SITES - 1).cast("long"))
    return parts.select("ord", "name", F.array_join(F.transform(sites, base), "").alias("seq"))


def build_tree_mash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all documents with a k-mer, by Mash distances of their nucleotide letters. Documents of fewer letters have no sketch and are no
    tips: that is the query, not a limit of build_tree."""
    docs = sequences(spark, sf_dir).where(F.length("seq") >= K).select(F.col("seq_id").cast("long").alias("ord"), F.concat(F.lit("d"), "seq_id").alias("name"), "seq")
    return build_tree(docs, "sequences", k=K, sketch_size=SIZE)


def build_tree_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all parts, by Jukes-Cantor distances of their alignments."""
    return build_tree(part_alignments(spark, sf_dir), "alignment")


def add_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every fourth part, and then all others onto it."""
    parts = materialized(part_alignments(spark, sf_dir), "parts")
    backbone = build_tree(parts.where("ord % 4 = 0"), "alignment")
    return add_to_tree(backbone, parts, "alignment")


# --- tree tables: region, nation, customer and order as one tree

NODES = """nodes AS (SELECT 'root' AS node, NULL AS parent, NULL::DOUBLE AS len
  UNION ALL SELECT 'r' || r_regionkey, 'root', 0.5::DOUBLE FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.1::DOUBLE * n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0.01::DOUBLE * (c_custkey % 9) FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 0.001::DOUBLE * (o_orderkey % 11) FROM orders)"""


def tree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def rows(name: str, letter: str, key: str, above: str, parent: str, length) -> DataFrame:
        return t(name).select(F.concat(F.lit(letter), F.col(key)).alias("node"), F.concat(F.lit(above), F.col(parent)).alias("parent"), length.alias("len"))

    root = t("region").limit(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("len"))
    regions = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(0.5).alias("len"))
    out = root.unionByName(regions).unionByName(rows("nation", "n", "n_nationkey", "r", "n_regionkey", 0.1 * F.col("n_nationkey")))
    out = out.unionByName(rows("customer", "c", "c_custkey", "n", "c_nationkey", 0.01 * (F.col("c_custkey") % 9)))
    return out.unionByName(rows("orders", "o", "o_orderkey", "c", "o_custkey", 0.001 * (F.col("o_orderkey") % 11)))


def tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.depths(tree_table(spark, sf_dir)).select("node", "depth", F.round("path", 6).alias("path"))


def tree_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.leaf_counts(tree_table(spark, sf_dir))


def prune_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the orders of odd total price, and without customers, nations and regions that then have no order left."""
    gone = table(spark, sf_dir, "orders").where("CAST(floor(o_totalprice) AS BIGINT) % 2 = 1").select(F.concat(F.lit("o"), "o_orderkey"))
    return T.prune(tree_table(spark, sf_dir), gone).select("node", F.coalesce("parent", F.lit("")).alias("parent"))


def prune_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the orders whose key is divisible by 7, without nodes of one child."""
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.concat(F.lit("o"), "o_orderkey"))
    ordering = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    bare = table(spark, sf_dir, "customer").join(ordering, "c_custkey", "left_anti").select(F.concat(F.lit("c"), "c_custkey"))
    got = T.without_unary(T.prune(tree_table(spark, sf_dir), gone.union(bare)))
    return got.select("node", F.coalesce("parent", F.lit("")).alias("parent"), F.round("len", 6).alias("len"))


def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.preorder(tree_table(spark, sf_dir))


def leaf_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.leaf_depths(tree_table(spark, sf_dir)), "mean_edges", "most_length", "mean_length")


def rescale_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level of the tree: least, greatest and mean length after a division by 2, zeros left out."""
    t = T.length_range(T.rescaled(tree_table(spark, sf_dir), 2.0).withColumn("level", F.substr("node", F.lit(1), F.lit(1))), "level")
    return _rounded(t, "least", "most", "mean")


def patristic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each order is from the order of the next key, and each customer from each region's first nation and its own."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    pairs = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("o"), F.col("o_orderkey") + 1).alias("b"))
    nations = customers.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.explode(F.array(*[F.concat(F.lit("n"), F.lit(k)) for k in range(5)], F.concat(F.lit("n"), "c_nationkey"))).alias("b")).distinct()
    return _rounded(T.patristic(tree_table(spark, sf_dir), pairs.union(nations)), "d")


def place_edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three new tips, at distances of no tree, would be put on every edge of the tree of all nations and suppliers."""
    s = table(spark, sf_dir, "supplier")
    t = lambda letter, key: F.concat(F.lit(letter), F.col(key))
    tree = s.select(t("s", "s_suppkey").alias("node"), t("n", "s_nationkey").alias("parent"), (0.01 * (1 + F.col("s_suppkey") % 7)).alias("len"))
    own = table(spark, sf_dir, "nation").join(s.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    tree = tree.union(own.select(t("n", "n_nationkey"), t("r", "n_regionkey"), 0.05 * (1 + F.col("n_nationkey") % 5))).union(own.select(t("r", "n_regionkey"), F.lit("root"), 0.1 * (1 + F.col("n_regionkey"))).distinct())
    tree = tree.union(own.limit(1).select(F.lit("root"), F.lit(None).cast("string"), F.lit(None).cast("double")))
    told = s.select(F.explode(F.array(*[F.lit(q) for q in range(3)])).alias("query"), t("s", "s_suppkey").alias("leaf"), (((F.col("s_suppkey") * 7919 + F.col("query") * 104729) % 1000) / 900.0).alias("d"))
    return _rounded(T.edge_costs(tree, told), "split", "pendant")


def build_tree_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each supplier is from the first eight in the tree that neighbor joining makes of the distances of all suppliers."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    s = materialized(s.select(F.col("s_suppkey").cast("int").alias("i"), "s_nationkey", "n_regionkey"), "suppliers")
    a, b = s.repartition(8 * spark.sparkContext.defaultParallelism, "i").toDF("i", "ni", "ri"), s.toDF("j", "nj", "rj")  # one file else is one task
    own = lambda k: 0.01 * (1 + F.col(k) % 7)
    edge = lambda x, y, w: F.when(F.col(x) != F.col(y), w(x) + w(y)).otherwise(0.0)
    d = own("i") + own("j") + edge("ni", "nj", lambda c: 0.02 * (1 + F.col(c) % 5)) + edge("ri", "rj", lambda c: 0.03 * (1 + F.col(c)))
    cells = a.join(b, F.col("j") < F.col("i")).select("i", "j", d.alias("d"))
    tree = materialized(build_tree(cells, "matrix", "nj", names=s.select("i", F.col("i").cast("string").alias("name"))), "supplier-tree")
    pairs = s.select(F.col("i").cast("long").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("b")).where("a > b")
    return _rounded(T.patristic(tree, pairs).select("a", "b", "d"), "d")


def add_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each customer is from the next in the given tree of regions, nations and every fourth customer with all others added
    to it, as a table that no task holds."""
    tips = materialized(customer_tips(spark, sf_dir), "customer-tips")
    old = tips.where(F.col("ord") % 4 == 0)
    nation, region = F.lit(GIVEN) - 100 - F.col("inner_"), F.lit(GIVEN) - 10 - F.col("outer_")
    given = old.select(F.col("ord").alias("node"), nation.alias("parent"), F.col("p").alias("len")).union(old.select(nation, region, "e").distinct()).union(old.select(region, F.lit(GIVEN), "r").distinct())
    edges = materialized(add_tips(materialized(given, "given-tree"), tips, nested_metric, compat=False, held=20, alike=ALIKE), "grown")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    tree = edges.unionByName(roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("len")))
    key = F.col("ord") % 1_000_000_000
    pairs = tips.select(key.alias("k"), F.col("ord").alias("a")).join(tips.select((key - 1).alias("k"), F.col("ord").alias("b")), "k").select("a", "b")
    return _rounded(T.patristic(tree, pairs).select("a", "b", "d"), "d")


def clade_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the tree of orders by status and priority against the one by priority and status."""
    tips = order_tips(spark, sf_dir).select("grp", "ord", "outer_", (F.col("inner_") % 10).alias("prio"))

    def clades(*levels: list[str]) -> DataFrame:
        # a clade is known by an order-free digest of its tips, so the rows stay small however large it is
        digest = [F.bit_xor(F.xxhash64("ord", F.lit(k))) for k in (1, 2)]
        parts = [tips.groupBy("grp", *cols).agg(F.struct(*digest, F.count("*")).alias("clade")).select(F.col("grp").alias("tree"), "clade") for cols in levels]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    return T.clade_distance(clades([], ["outer_"], ["outer_", "prio"]), clades([], ["prio"], ["prio", "outer_"]))


def tree_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the same two trees without regard to their roots."""
    tips = order_tips(spark, sf_dir).select("grp", F.col("ord").cast("string").alias("ord"), F.col("outer_").cast("string").alias("s"), (F.col("inner_") % 10).cast("string").alias("p"))

    def tree(first: str, second: str) -> DataFrame:
        names = [F.lit("root"), F.concat(F.lit("a"), first), F.concat(F.lit("b"), first, F.lit("-"), second), F.concat(F.lit("t"), "ord")]
        out = tips.select(F.col("grp").alias("tree"), names[0].alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("leaf")).distinct()
        for k in (1, 2, 3):
            out = out.union(tips.select(F.col("grp").alias("tree"), names[k].alias("node"), names[k - 1].alias("parent"), (F.col("ord") if k == 3 else F.lit(None)).alias("leaf")).distinct())
        return out

    return _rounded(T.robinson_foulds(tree("s", "p"), tree("p", "s")), "nrf")


TREE_SQL = {
    "tree_depths": f"""WITH RECURSIVE {NODES}, down AS (SELECT node, 0::BIGINT AS depth, 0::DOUBLE AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, d.depth + 1, d.path + n.len FROM nodes n JOIN down d ON n.parent = d.node) SELECT node, depth, round(path, 6) AS path FROM down""",
    "tree_leaf_counts": f"""WITH RECURSIVE {NODES}, up AS (SELECT node, parent AS above, (node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL))::BIGINT AS leaf FROM nodes WHERE parent IS NOT NULL
  UNION ALL SELECT u.node, n.parent, u.leaf FROM up u JOIN nodes n ON n.node = u.above WHERE n.parent IS NOT NULL)
SELECT above AS node, sum(leaf)::BIGINT AS n_leaves, count(*) AS n_nodes FROM up GROUP BY above""",
    "prune_leaves": f"""WITH RECURSIVE {NODES}, kept(node) AS (SELECT n.node FROM nodes n WHERE n.node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)
    AND n.node NOT IN (SELECT 'o' || o_orderkey FROM orders WHERE floor(o_totalprice)::BIGINT % 2 = 1)
  UNION SELECT n.parent FROM nodes n JOIN kept k ON k.node = n.node WHERE n.parent IS NOT NULL)
SELECT node, coalesce(parent, '') AS parent FROM nodes WHERE node IN (SELECT node FROM kept)""",
    "rescale_lengths": f"""WITH {NODES}, s AS (SELECT substr(node, 1, 1) AS level, CASE WHEN len = 0 THEN 0 WHEN len / 2 <= 0 THEN 1e-7::DOUBLE ELSE len / 2 END AS len FROM nodes WHERE len IS NOT NULL)
SELECT level, count(*) AS n, round(min(len) FILTER (len <> 0), 6) AS least, round(max(len) FILTER (len <> 0), 6) AS most, round(avg(len) FILTER (len <> 0), 6) AS mean FROM s GROUP BY level""",
    "patristic_pairs": f"""WITH RECURSIVE {NODES}, up AS (SELECT node, node AS above, 0::DOUBLE AS way, 0::BIGINT AS k FROM nodes
  UNION ALL SELECT u.node, n.parent, u.way + n.len, u.k + 1 FROM up u JOIN nodes n ON n.node = u.above WHERE n.parent IS NOT NULL),
pairs AS (SELECT 'o' || o_orderkey AS a, 'o' || (o_orderkey + 1) AS b FROM orders UNION SELECT 'c' || c_custkey, 'n' || unnest([0, 1, 2, 3, 4, c_nationkey]) FROM customer)
SELECT a, b, x.above AS lca, x.k + y.k AS edges, round(x.way + y.way, 6) AS d FROM pairs JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.above = x.above
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY x.k) = 1""",
    "place_edge_costs": """WITH RECURSIVE edges AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS parent, 0.01::DOUBLE * (1 + s_suppkey % 7) AS len FROM supplier
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.05::DOUBLE * (1 + n_nationkey % 5) FROM nation JOIN supplier ON s_nationkey = n_nationkey
  UNION SELECT 'r' || n_regionkey, 'root', 0.1::DOUBLE * (1 + n_regionkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey),
links AS (SELECT node AS x, parent AS y, len FROM edges UNION ALL SELECT parent, node, len FROM edges),
ways AS (SELECT 's' || s_suppkey AS leaf, 's' || s_suppkey AS at_, '' AS back, 0::DOUBLE AS far FROM supplier
  UNION ALL SELECT w.leaf, l.y, w.at_, w.far + l.len FROM ways w JOIN links l ON l.x = w.at_ AND l.y <> w.back),
told AS (SELECT q AS query, 's' || s_suppkey AS leaf, (s_suppkey * 7919 + q * 104729) % 1000 / 900.0::DOUBLE AS d FROM supplier, (SELECT unnest(range(3)) AS q)),
ends AS (SELECT query, l.x, l.y, greatest(0, max(d - far)) AS bound FROM links l JOIN ways w ON w.at_ = l.x AND w.back <> l.y JOIN told t ON t.leaf = w.leaf GROUP BY ALL),
ab AS (SELECT query, e.node, e.parent, e.len, coalesce(f.bound, 0) AS a, coalesce(g.bound, 0) AS b FROM edges e CROSS JOIN (SELECT unnest(range(3)) AS query) LEFT JOIN ends f USING (query) LEFT JOIN ends g USING (query)
  WHERE f.x = e.parent AND f.y = e.node AND g.x = e.node AND g.y = e.parent),
p0 AS (SELECT *, greatest(0, (a + b - len) / 2) AS p FROM ab), p1 AS (SELECT * REPLACE (greatest(0, a - p) AS a, greatest(0, b - p) AS b) FROM p0),
p2 AS (SELECT * REPLACE (a - greatest(0, a - len) AS a, p + greatest(0, a - len) AS p) FROM p1), p3 AS (SELECT * REPLACE (b - greatest(0, b - len) AS b, p + greatest(0, b - len) AS p) FROM p2)
SELECT CAST(query AS INT) AS query, node, parent, round(a + (len - a - b) / 2, 6) AS split, round(p, 6) AS pendant FROM p3""",
    "build_tree_matrix": """WITH s AS (SELECT s_suppkey AS i, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT x.i AS a, y.i AS b, round(0.01::DOUBLE * (2 + x.i % 7 + y.i % 7) + CASE WHEN x.n <> y.n THEN 0.02::DOUBLE * (2 + x.n % 5 + y.n % 5) ELSE 0 END + CASE WHEN x.r <> y.r THEN 0.03::DOUBLE * (2 + x.r + y.r) ELSE 0 END, 6) AS d
FROM s x JOIN s y ON y.i < 8 AND x.i > y.i""",
    "add_customers": f"""WITH {CUSTOMERS}, k AS (SELECT *, ord % 1000000000 AS c FROM tips)
SELECT x.ord AS a, y.ord AS b, round(x.p + y.p + CASE WHEN x.inner_ <> y.inner_ THEN x.e + y.e ELSE 0 END + CASE WHEN x.outer_ <> y.outer_ THEN x.r + y.r ELSE 0 END, 6) AS d FROM k x JOIN k y ON y.c = x.c + 1""",
    "tree_preorder": f"""WITH RECURSIVE {NODES}, down AS (SELECT node, [node] AS way FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, list_append(d.way, n.node) FROM nodes n JOIN down d ON n.parent = d.node) SELECT node, row_number() OVER (ORDER BY way) - 1 AS place FROM down""",
    "leaf_depths": f"""WITH RECURSIVE {NODES}, down AS (SELECT node, 0::BIGINT AS depth, 0::DOUBLE AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, d.depth + 1, d.path + n.len FROM nodes n JOIN down d ON n.parent = d.node)
SELECT count(*) AS n_leaves, max(depth) AS most_edges, round(avg(depth), 6) AS mean_edges, round(max(path), 6) AS most_length, round(avg(path), 6) AS mean_length FROM down WHERE node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)""",
    "prune_unary": f"""WITH RECURSIVE {NODES}, kept(node) AS (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 7 = 0
  UNION SELECT n.parent FROM nodes n JOIN kept k ON k.node = n.node WHERE n.parent IS NOT NULL),
k AS (SELECT n.* FROM nodes n JOIN kept USING (node)), single AS (SELECT parent AS node FROM k WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1),
climb AS (SELECT node, parent AS at_, len FROM k WHERE node NOT IN (SELECT node FROM single)
  UNION ALL SELECT c.node, k.parent, c.len + k.len FROM climb c JOIN k ON k.node = c.at_ WHERE c.at_ IN (SELECT node FROM single))
SELECT node, coalesce(at_, '') AS parent, CASE WHEN at_ IS NOT NULL THEN round(len, 6) END AS len FROM climb WHERE at_ IS NULL OR at_ NOT IN (SELECT node FROM single)""",
    "tree_rf": f"""WITH {TIPS}, t AS (SELECT grp, ord, outer_ AS s, inner_ % 10 AS p FROM tips), g AS (SELECT grp, count(*) AS total, min(ord) AS least FROM t GROUP BY grp),
c AS (SELECT 'x' AS tree, grp, 'a' || s AS clade, ord FROM t UNION ALL SELECT 'x', grp, 'b' || s || '-' || p, ord FROM t UNION ALL SELECT 'y', grp, 'a' || p, ord FROM t UNION ALL SELECT 'y', grp, 'b' || s || '-' || p, ord FROM t),
n AS (SELECT tree, grp, clade, count(*) AS n, min(ord) AS lo FROM c GROUP BY ALL),
sides AS (SELECT n.tree, n.grp, n.clade, list(t.ord ORDER BY t.ord) AS side FROM n JOIN g ON g.grp = n.grp JOIN t ON t.grp = n.grp LEFT JOIN c ON c.tree = n.tree AND c.grp = n.grp AND c.clade = n.clade AND c.ord = t.ord
  WHERE n.n > 1 AND n.n < total - 1 AND (lo = least) = (c.ord IS NULL) GROUP BY ALL),
w AS (SELECT grp, side, bool_or(tree = 'x') AS a, bool_or(tree = 'y') AS b FROM sides GROUP BY grp, side)
SELECT g.grp AS tree, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a) + count(*) FILTER (b) - 2 * count(*) FILTER (a AND b) AS rf,
  round(coalesce((count(*) FILTER (a) + count(*) FILTER (b) - 2 * count(*) FILTER (a AND b)) / nullif(count(*) FILTER (a) + count(*) FILTER (b), 0)::DOUBLE, 0), 6) AS nrf
FROM g LEFT JOIN w ON w.grp = g.grp GROUP BY g.grp""",
    "clade_rf": f"""WITH {TIPS}, t AS (SELECT grp, ord, outer_, inner_ % 10 AS prio FROM tips),
x AS (SELECT grp, list(ord ORDER BY ord) AS c FROM t GROUP BY grp UNION SELECT grp, list(ord ORDER BY ord) FROM t GROUP BY grp, outer_ UNION SELECT grp, list(ord ORDER BY ord) FROM t GROUP BY grp, outer_, prio),
y AS (SELECT grp, list(ord ORDER BY ord) AS c FROM t GROUP BY grp UNION SELECT grp, list(ord ORDER BY ord) FROM t GROUP BY grp, prio UNION SELECT grp, list(ord ORDER BY ord) FROM t GROUP BY grp, outer_, prio)
SELECT grp AS tree, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a) + count(*) FILTER (b) - 2 * count(*) FILTER (a AND b) AS rf
FROM (SELECT coalesce(x.grp, y.grp) AS grp, x.c IS NOT NULL AS a, y.c IS NOT NULL AS b FROM x FULL JOIN y ON x.grp = y.grp AND x.c = y.c) GROUP BY grp""",
}

QUERIES = {
    "kmer_counts": kmer_counts,
    "kmer_hash": kmer_hash,
    "bottom_sketch": bottom_sketch,
    "mash_neighbors": mash_neighbors,
    "mash_distances": mash_distances,
    **{f"dist_{m}": _distances(m) for m in D.MODELS},
    **{f"dist_{m}_as_written": _distances(m, True) for m in ("tn", "tamura")},
    "row_sums_u": row_sums_u,
    "nj_q_argmin": nj_q_argmin,
    "nj_paths": nj_paths,
    "nj_undefined": nj_undefined,
    "place_exact": _placed("exact"),
    "place_k_closest": _placed("k_closest"),
    "divide_and_conquer": divide_and_conquer,
    "build_tree_mash": build_tree_mash,
    "build_tree_msa": build_tree_msa,
    "add_to_tree": add_parts,
    "tree_depths": tree_depths,
    "tree_leaf_counts": tree_leaf_counts,
    "tree_preorder": tree_preorder,
    "leaf_depths": leaf_depths,
    "prune_leaves": prune_leaves,
    "prune_unary": prune_unary,
    "rescale_lengths": rescale_lengths,
    "patristic_pairs": patristic_pairs,
    "place_edge_costs": place_edge_costs,
    "build_tree_matrix": build_tree_matrix,
    "add_customers": add_customers,
    "clade_rf": clade_rf,
    "tree_rf": tree_rf,
}
ORACLES = {
    "kmer_counts": f"WITH {KMERS} SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer",
    "kmer_hash": f"WITH {KMERS}, distinct_kmers AS (SELECT DISTINCT kmer FROM kmers), {_hashed('distinct_kmers')} SELECT kmer, CAST(h AS VARCHAR) AS h FROM hashed",
    "bottom_sketch": f"WITH {SKETCH} SELECT doc_id AS seq_id, coalesce(max(n_kmers), 0) AS n_kmers, count(h) AS n_kept, CAST(min(h) AS VARCHAR) AS least, CAST(max(h) AS VARCHAR) AS most FROM documents LEFT JOIN sketch ON seq_id = doc_id GROUP BY doc_id",
    "mash_neighbors": NEIGHBORS,
    "mash_distances": MASH,
    **{f"dist_{m}": _distance_sql(m) for m in D.MODELS},
    **{f"dist_{m}_as_written": _distance_sql(m, True) for m in ("tn", "tamura")},
    "row_sums_u": f"WITH {TIPS} SELECT grp, i, round(sum(d)::DOUBLE, 6) AS u FROM d GROUP BY grp, i HAVING count(*) > 1",
    "nj_q_argmin": Q_SQL,
    "nj_undefined": f"WITH {TIPS} SELECT grp, count(*) AS n_tips, 2 * count(*) - 2 AS n_edges, 2 * count(*) - 2 AS n_children, 0 AS n_bad, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS n_roots FROM tips GROUP BY grp",
    "nj_paths": f"{PATHS} SELECT grp, ord, first, total FROM s",
    "place_exact": f"{PATHS} SELECT grp, ord, first, total, depth FROM s",
    "place_k_closest": f"{PATHS} SELECT grp, ord, first, total, depth FROM s",
    "divide_and_conquer": DC_SQL,
    **TREE_SQL,
}
