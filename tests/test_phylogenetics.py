import gzip
import math
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from cladespark.functions.murmur import hash_strings
from cladespark.functions.nucleotides import canonical, four_bit, kmers, reverse_complement, two_bit
from cladespark.operators import distance as D
from cladespark.operators import trees as T
from cladespark.operators.build import add_to_tree, build_tree, distances
from cladespark.operators.kernels import attached, neighbor_joining, path_lengths, place_all
from cladespark.operators.placement import algorithm_for, place_tips
from cladespark.operators.sketch import crossed_shared, mash_distance, sequence_hashes, shared_hashes
from cladespark.plans import queries as Q
from cladespark.sources import files
from cladespark.streaming.insertion import Backbone, insert_stream, placements
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


def same_as_sql(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = query(spark, DATA)
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert mine == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name):
    same_as_sql(spark, name, Q.QUERIES[name], Q.ORACLES[name])


def test_every_query_is_registered():
    assert set(Q.QUERIES) <= set(__spark_entry__.queries()) and set(Q.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_nucleotide_columns(spark):
    df = spark.createDataFrame([("ACGTUNacgt-",), ("",), ("AACG",)], "s string")
    rows = df.select(two_bit(F.col("s")).alias("a"), four_bit(F.col("s")).alias("b"), reverse_complement(F.lit("AACG")).alias("r"), canonical(F.lit("CGTT")).alias("c"), kmers(F.col("s"), 3).alias("k")).collect()
    assert rows[0].a == "ACGTTAAAAAA" and rows[0].b == "ACGTT------" and rows[0].r == "CGTT" and rows[0].c == "AACG"
    assert rows[1].k == [] and rows[2].k == ["AAC", "ACG"]


def test_murmur_of_every_length():
    def reference(data, seed=42):
        m, (h1, h2) = (1 << 64) - 1, (seed, seed)
        c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
        rot = lambda x, r: ((x << r) | (x >> (64 - r))) & m
        whole = len(data) // 16
        for b in range(whole):
            k1, k2 = (int.from_bytes(data[16 * b + s : 16 * b + s + 8], "little") for s in (0, 8))
            h1 = (rot(h1 ^ rot(k1 * c1 & m, 31) * c2 & m, 27) + h2) * 5 + 0x52DCE729 & m
            h2 = (rot(h2 ^ rot(k2 * c2 & m, 33) * c1 & m, 31) + h1) * 5 + 0x38495AB5 & m
        tail = data[16 * whole :]
        if len(tail) > 8:
            h2 ^= rot(int.from_bytes(tail[8:], "little") * c2 & m, 33) * c1 & m
        if tail:
            h1 ^= rot(int.from_bytes(tail[:8], "little") * c1 & m, 31) * c2 & m
        h1, h2 = h1 ^ len(data), h2 ^ len(data)
        h1 = h1 + h2 & m
        h2 = h2 + h1 & m

        def fix(k):
            k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & m
            k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & m
            return k ^ k >> 33

        return fix(h1) + fix(h2) & m

    texts = ["ACGT" * 20][0]
    for n in range(1, 50):
        assert int(hash_strings([texts[:n]])[0]) + (1 << 63) == reference(texts[:n].encode())


def test_mash_against_a_walk_over_both_sketches():
    random = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.sort(random.integers(0, 12, random.integers(0, 12))) for _ in range(2))
        size = 10
        pad = lambda x: [*x[:size], *[99] * (size - len(x[:size]))]
        p, q, shared, seen, at = pad(a), pad(b), 0, 0, 0
        for x in p:
            if seen >= size:
                break
            while seen < size and at < size and q[at] <= x:
                shared, seen = (shared + 1, seen) if q[at] == x else (shared, seen + 1)
                at += 1
            seen += seen < size
        assert shared_hashes(np.array(p), np.array(q), size, False) == shared
    assert mash_distance(1000, 1000, 15) == 0 and math.isclose(mash_distance(0, 1000, 15), 0.414374, abs_tol=1e-6)


def test_distance_goldens():
    p = D.distances(np.array([D.joint_counts("ACGT-", "ACCTA")]), "p")[0]
    assert math.isclose(p, 0.4) and math.isclose(D.distances(np.array([D.joint_counts("ACGT-", "ACCTA")]), "jc")[0], 0.571605, abs_tol=1e-6)
    a, b = "A" * 20, "GGC" + "A" * 17
    n = np.array([D.joint_counts(a, b)])
    assert math.isclose(D.distances(n, "k2p")[0], 0.170181, abs_tol=1e-6) and math.isclose(D.distances(n, "jinnei")[0], 0.194444, abs_tol=1e-6)
    equal = np.array([D.joint_counts("ACGT", "ACGT")])
    assert D.distances(equal, "tn")[0] == 0 and D.distances(equal, "tamura")[0] == 0
    assert np.isnan(D.distances(equal, "tn", True)[0]) and np.isnan(D.distances(np.array([D.joint_counts("--", "--")]), "p")[0])


def test_trees_of_path_lengths_give_them_back():
    random = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 25):
        g, p = random.integers(0, 4, n), random.uniform(0.0, 0.1, n)
        d = p[:, None] + p[None] + 0.1 * (g[:, None] != g[None]) + 0.2 * (g[:, None] // 2 != g[None] // 2)
        np.fill_diagonal(d, 0)
        for edges in (neighbor_joining(d), place_all(d, None), place_all(d)):
            assert len(edges) == max(0, 2 * n - 2) and all(x >= -1e-12 for *_, x in edges)
            assert np.allclose(path_lengths(edges, [*range(n)]), d)


def test_sketches_of_many_pairs():
    """All pairs at once equal the walk pair by pair, with repetitions, filling and either order."""
    random = np.random.default_rng(5)
    for size in (4, 10):
        x, y = ([np.sort(random.integers(0, 15, random.integers(0, size + 1))) for _ in range(n)] for n in (7, 9))
        first = random.integers(0, 2, (7, 9)).astype(bool)
        want = [[shared_hashes(a, b, size) if first[i, j] else shared_hashes(b, a, size) for j, b in enumerate(y)] for i, a in enumerate(x)]
        assert crossed_shared(x, y, first, size).tolist() == want


def test_hashes_of_canonical_kmers():
    seq = "".join(np.random.default_rng(6).choice([*"ACGT"], 400))
    for k in (1, 7, 15, 31):
        other = {"A": "T", "C": "G", "G": "C", "T": "A"}
        lesser = [min(seq[i : i + k], "".join(other[c] for c in reversed(seq[i : i + k]))) for i in range(len(seq) - k + 1)]
        assert sequence_hashes(seq, k).tolist() == hash_strings(lesser).tolist()
    assert len(sequence_hashes("ACG", 4)) == 0


def attach_by_hand(d, links, leaves, nearest, inner):
    """Where a query goes, told from paths between all nodes: every edge anew, with the nearest leaves of either side."""
    def reach(start, back):
        far, todo = {start: 0.0}, [start]
        for v in todo:
            for w, length in links[v].items():
                if w not in far and not (v == start and w == back):
                    far[w] = far[v] + length
                    todo.append(w)
        return far

    best = None
    for x in links:
        for y, length in links[x].items():
            if x > y:
                ends = []
                for own, other in ((x, y), (y, x)):
                    near = sorted((p, leaves.index(v), v) for v, p in reach(own, other).items() if v in leaves)
                    near = [n for n in near if n[0] < 2][:nearest] if nearest else near
                    ends.append(max([0.0, *(d[v] - p for p, _, v in near)]))
                split, pendant = (float(v) for v in attached(np.array(ends[0]), np.array(ends[1]), np.array(length)))
                if best is None or pendant < best[0] - 1e-12:
                    best = (pendant, {(x, y)})
                elif abs(pendant - best[0]) <= 1e-12:
                    best[1].add((x, y))
    return best


@pytest.mark.parametrize("nearest", [2, 5, None])
def test_placement_of_distances_of_no_tree(nearest):
    """Random distances, with ties where no list is cut: every placement has the shortest pendant edge that a search of all edges finds."""
    from cladespark.operators.kernels import Placement

    random = np.random.default_rng(7)
    for _ in range(12):
        n = 14
        d = np.round(random.uniform(0.05, 0.9, (n, n)), 9 if nearest else 1)
        d = np.triu(d, 1) + np.triu(d, 1).T
        tree = Placement(n, nearest=nearest)
        tree.start(0, 1, d[0, 1])
        for tip in range(2, n):
            links = {v: {int(tree.dst[k]): float(tree.length[k]) for k in ks} for v, ks in tree.out.items()}
            half, split, pendant = (v[0] for v in tree.places(d[tip][None]))
            want, edges = attach_by_hand(d[tip], links, [*range(tip)], nearest, n)
            assert pendant == pytest.approx(want) and {(int(tree.src[half]), int(tree.dst[half])), (int(tree.dst[half]), int(tree.src[half]))} & edges
            tree.insert(tip, int(half), float(split), float(pendant))


def test_neighbor_joining_of_distances_of_no_tree():
    """Each join is the best of all pairs, told from whole sums; of the two that are always equal among four, the first by slots."""
    random = np.random.default_rng(8)
    for n in (3, 4, 8, 15):
        d = np.triu(random.uniform(0.1, 1, (n, n)), 1)
        d = d + d.T
        live, far, want, new = [*range(n)], {(i, j): d[i, j] for i in range(n) for j in range(n)}, [], n
        while len(live) > 2:
            u = {i: sum(far[i, j] for j in live if j != i) for i in live}
            q = {(i, j): far[live[i], live[j]] - (u[live[i]] + u[live[j]]) / (len(live) - 2) for j in range(len(live)) for i in range(j)}
            i, j = min(p for p in q if q[p] <= min(q.values()) + 1e-12)
            x, y = live[i], live[j]
            bx = (far[x, y] + (u[x] - u[y]) / (len(live) - 2)) / 2
            by = far[x, y] - bx
            bx, by = (0.0, by + bx) if bx < 0 else (bx, by)
            bx, by = (bx + by, 0.0) if by < 0 else (bx, by)
            want += [(x, new, bx), (y, new, by)]
            far[new, new] = 0.0
            for k in live:
                far[new, k] = far[k, new] = (far[x, k] + far[y, k] - far[x, y]) / 2
            live[i], live[j] = new, live[-1]
            live.pop()
            new += 1
        a, b = live
        want += [(a, new, far[a, b] / 2), (b, new, far[a, b] / 2)]
        got = neighbor_joining(d)
        assert sorted((c, p) for c, p, _ in got) == sorted((c, p) for c, p, _ in want)
        assert np.allclose(sorted(x for *_, x in got), sorted(x for *_, x in want))


def test_far_queries():
    """A query that is far from everything: on the first edge in the matched form, where it belongs without."""
    d = np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0.0]])
    assert {c: x for c, _, x in place_all(d)}[2] == 2.0 and {c: x for c, _, x in place_all(d, compat=False)}[2] == pytest.approx(8.5)


def test_third_tip():
    d = np.array([[0, 0.3, 0.5], [0.3, 0, 0.6], [0.5, 0.6, 0]])
    lengths = {c: x for c, _, x in place_all(d)}
    assert math.isclose(lengths[2], 0.4) and math.isclose(lengths[0], 0.1)
    assert math.isclose(lengths[4], 0.05, abs_tol=1e-9)


def test_files(spark, tmp_path):
    fasta = tmp_path / "a.fa.gz"
    fasta.write_bytes(gzip.compress(b">s1 comment\r\nACG\r\n\r\nTT\r\n>s2\nGG>G\n"))
    rows = files.read_fasta(spark, str(fasta)).orderBy("ord").collect()
    assert [(r.name, r.seq) for r in rows] == [("s1", "ACGTT"), ("s2", "GG>G")]
    fastq = tmp_path / "a.fq"
    fastq.write_text("@q1 x\nACGT\n+\n@III\n@q2\nAC\n+\nI\n")
    assert [(r.name, r.seq) for r in files.read_fastq(spark, str(fastq)).collect()] == [("q1", "ACGT")]
    matrix = tmp_path / "m.phy"
    matrix.write_text("3\na\nb\t0.5\nc\t0.25\t1.5\n")
    names, dist = files.read_phylip_matrix(spark, str(matrix))
    assert [r.name for r in names.orderBy("i").collect()] == ["a", "b", "c"]
    assert {(r.i, r.j, r.d) for r in dist.collect()} == {(1, 0, 0.5), (2, 0, 0.25), (2, 1, 1.5)}
    files.write_phylip_matrix(names, dist.select("i", "j", "d"), str(tmp_path / "out"))
    again = files.read_phylip_matrix(spark, str(tmp_path / "out"))[1]
    assert {(r.i, r.j, r.d) for r in again.collect()} == {(1, 0, 0.5), (2, 0, 0.25), (2, 1, 1.5)}
    phylip = tmp_path / "p.phy"
    phylip.write_text(" 2 6\nname one  ACG TTT\nb         AAAAAA\n")
    assert [(r.name, r.seq) for r in files.read_phylip_sequences(spark, str(phylip)).orderBy("ord").collect()] == [("name one", "ACGTTT"), ("b", "AAAAAA")]


def test_converters(spark, tmp_path):
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, name string")
    dist = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.25), (2, 1, 1.5)], "i long, j long, d double")
    text = lambda p: [r.value for r in spark.read.text(str(tmp_path / p)).coalesce(1).collect()]
    files.write_square_matrix(names, dist, str(tmp_path / "square"))
    assert sorted(text("square")) == ["3", "a\t0.0\t0.5\t0.25", "b\t0.5\t0.0\t1.5", "c\t0.25\t1.5\t0.0"]
    assert {(r.i, r.j, r.d) for r in files.read_phylip_matrix(spark, str(tmp_path / "square"))[1].collect()} == {(1, 0, 0.5), (2, 0, 0.25), (2, 1, 1.5)}
    files.write_tab_matrix(names, dist, str(tmp_path / "tab"))
    assert sorted(text("tab")) == ["\ta\tb\tc", "a\t0.0\t0.5\t0.25", "b\t0.5\t0.0\t1.5", "c\t0.25\t1.5\t0.0"]
    left, cells = files.excluded(names, dist, spark.createDataFrame([("b",)], "n string"))
    assert [r.name for r in left.orderBy("i").collect()] == ["a", "c"] and [(r.i, r.j) for r in cells.collect()] == [(2, 0)]
    seqs = spark.createDataFrame([(0, "a", "AC-T"), (1, "b", "ACGT"), (2, "longer_than_ten", "A--T")], "ord long, name string, seq string")
    files.write_stockholm(seqs, str(tmp_path / "sto"))
    assert [(r.name, r.seq) for r in files.read_stockholm(spark, str(tmp_path / "sto")).orderBy("ord").collect()] == [(r.name, r.seq) for r in seqs.collect()]
    files.write_phylip_sequences(seqs, str(tmp_path / "phy"))
    assert {(r.name, r.seq) for r in files.read_phylip_sequences(spark, str(tmp_path / "phy")).collect()} == {("a", "AC-T"), ("b", "ACGT"), ("longer_tha", "A--T")}
    tree = spark.createDataFrame([(0, None, None), (1, 0, "a"), (2, 0, "b")], "node long, parent long, name string")
    assert sorted(r.name for r in files.of_leaves(seqs, tree).collect()) == ["a", "b"] and files.sampled_sequences(seqs, 2).count() == 2
    files.write_split(seqs, str(tmp_path / "split"))
    assert {(r.name, r.value) for r in spark.read.text(str(tmp_path / "split")).collect()} >= {("a", ">a"), ("b", "ACGT")}
    (tmp_path / "x.fa").write_text(">1\nAC\nG\n>2\nTT\n")
    assert [(r.name, r.seq) for r in files.concatenated(spark, str(tmp_path / "x.fa")).collect()] == [("x", "ACGTT")]
    ids = {r.name: r.id for r in files.numbered(seqs, spark.createDataFrame([("b", 7)], "name string, id long")).collect()}
    assert ids == {"a": 8, "b": 7, "longer_than_ten": 9}


CHAIN = [(k, k - 1 if k else None, 0.5) for k in range(21)] + [(100 + k, k, 1.0) for k in (3, 20)]


def test_deep_trees(spark):
    """A chain of twenty edges, with leaves at both ends of it and in between."""
    tree = spark.createDataFrame(CHAIN, "node long, parent long, len double")
    counts = {r.node: (r.n_leaves, r.n_nodes) for r in T.leaf_counts(tree).collect()}
    assert counts == {k: (2 if k <= 3 else 1, 22 - k if k <= 3 else 21 - k) for k in range(21)}
    far = {r.node: (r.depth, r.path) for r in T.depths(tree).collect()}
    assert far[120] == (21, 11.0) and far[0] == (0, 0.0)
    nothing = spark.createDataFrame([], "leaf long")
    assert T.prune(tree, nothing).count() == 23
    assert {r.node for r in T.prune(tree, spark.createDataFrame([(120,)], "leaf long")).collect()} == {0, 1, 2, 3, 103}
    assert {(r.node, r.parent, r.len) for r in T.without_unary(tree).collect()} == {(3, None, None), (103, 3, 1.0), (120, 3, 9.5)}
    assert [r.node for r in T.preorder(tree).orderBy("place").collect()] == [0, 1, 2, 3, *range(4, 21), 120, 103]
    assert T.sampled(tree, 1).count() == 1


def leaves_below(tree):
    below = {}
    for r in tree:
        below.setdefault(r.parent, []).append(r)
    def walk(node):
        return frozenset([node.name]) if node.node not in below else frozenset().union(*(walk(c) for c in below[node.node]))
    return {r.node: walk(r) for r in tree}


def bipartitions(rows):
    sets = leaves_below(rows)
    every = max(sets.values(), key=len)
    least = min(every)
    return {s if least not in s else every - s for s in sets.values() if 1 < len(s) < len(every) - 1}


def tips_frame(spark, n, seed):
    random = np.random.default_rng(seed)
    base = random.choice([*"ACGT"], 300)
    groups = [np.where(random.uniform(size=300) < 0.2, random.choice([*"ACGT"], 300), base) for _ in range(5)]
    rows = []
    for k in range(n):
        own = np.where(random.uniform(size=300) < 0.05, random.choice([*"ACGT-"], 300), groups[k % 5])
        rows.append((k, f"t{k}", "".join(own)))
    return spark.createDataFrame(rows, "ord long, name string, seq string")


def test_trees_from_sequences(spark):
    df = tips_frame(spark, 40, 1)
    for kind, algorithm in (("alignment", "nj"), ("alignment", "place"), ("sequences", "auto"), ("alignment", "divide")):
        rows = build_tree(df, kind, algorithm, most=6, chunk=7).collect()
        assert sorted(r.name for r in rows if r.name) == sorted(f"t{k}" for k in range(40)) and len(rows) == 79
        assert sum(r.parent is None for r in rows) == 1 and all(r.len >= 0 for r in rows if r.parent is not None)
        if kind == "alignment" and algorithm != "divide":  # the five groups are clades of the unrooted tree; three backbone tips are too few for that
            assert all(frozenset(f"t{k}" for k in range(g, 40, 5)) in {s for p in bipartitions(rows) for s in (p, frozenset(f"t{k}" for k in range(40)) - p)} for g in range(5))
    text = files.trees_to_newick(build_tree(df, "alignment").withColumn("tree", F.lit(1))).first().newick
    assert sorted(r[2] for r in files.parse_newick(text) if r[2]) == sorted(f"t{k}" for k in range(40))


def test_single_task_trees_equal_the_kernels(spark):
    df = tips_frame(spark, 25, 2)
    rows = df.orderBy("ord").toPandas()
    d = D.alignment_metric("k2p")(rows, rows)
    for algorithm, edges in (("nj", neighbor_joining(d)), ("place", place_all(d))):
        got = build_tree(df, "alignment", algorithm, distance="k2p", seed=None)
        lengths = got.where("name IS NOT NULL").toPandas().set_index("name")["len"]
        assert all(lengths[f"t{c}"] == pytest.approx(x) for c, _, x in edges if c < 25)
    cells = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(25) for j in range(i)], "i int, j int, d double")
    names = df.select(F.col("ord").alias("i"), "name")
    lengths = build_tree(cells, "matrix", "nj", names=names).where("name IS NOT NULL").toPandas().set_index("name")["len"]
    assert all(lengths[f"t{c}"] == pytest.approx(x) for c, _, x in neighbor_joining(d) if c < 25)


def test_divide_and_conquer_gives_back_the_tree(spark):
    """Path lengths of a tree come back whatever the sizes of backbone, clusters and tasks are, and so does the tree itself."""
    tips = Q.customer_tips(spark, DATA)
    rows = tips.orderBy("ord").toPandas()
    want = Q.nested_metric(rows, rows)
    for most, chunk in ((4, 9), (500, 4000)):
        edges = [tuple(r) for r in place_tips(tips, Q.nested_metric, begin=4, most=most, chunk=chunk, compat=False).collect()]
        assert len(edges) == 2 * len(rows) - 2 and len({c for c, *_ in edges}) == len(edges)
        assert np.allclose(path_lengths(edges, rows["ord"].tolist()), want)


def test_adding_tips_to_a_tree(spark):
    df = tips_frame(spark, 36, 3)
    newick = files.trees_to_newick(build_tree(df.where("ord < 12"), "alignment").withColumn("tree", F.lit(1)), digits=12)
    backbone = files.trees_from_newick(newick).drop("tree")
    before = bipartitions(backbone.collect())
    old = frozenset(f"t{k}" for k in range(12))
    for most in (500, 5):
        rows = add_to_tree(backbone, df, "alignment", most=most, chunk=8).collect()
        assert sorted(r.name for r in rows if r.name) == sorted(f"t{k}" for k in range(36)) and len(rows) == 71
        kept = {s & old for s in bipartitions(rows)}
        assert before <= kept | {old - s for s in kept}  # the given splits stay
    with pytest.raises(ValueError, match="no sequence"):
        add_to_tree(backbone, df.where("ord > 3"), "alignment")


def test_distances_in_blocks(spark):
    df = tips_frame(spark, 30, 4)
    rows = df.orderBy("ord").toPandas()
    d = D.alignment_metric("jc")(rows, rows)
    got = {(r.i, r.j): r.d for r in distances(df, "alignment", block=7).collect()}
    assert got.keys() == {(i, j) for i in range(30) for j in range(i)} and all(v == pytest.approx(d[k]) for k, v in got.items())
    family = df.select(F.lit(1).alias("g"), "ord", F.col("seq").alias("aln"))
    for block in (7, 100):
        got = {(r.i, r.j): r.d for r in D.pair_distances(family, "g", "jc", family=5, block=block).collect()}
        assert got.keys() == {(j, i) for i in range(30) for j in range(i)} and all(v == pytest.approx(d[k]) for k, v in got.items())
    pairs = spark.createDataFrame([(3, 9), (9, 3), (0, 1)], "i long, j long")
    assert {(r.i, r.j): round(r.d, 9) for r in D.candidate_distances(pairs, family, "jc").collect()} == {k: round(d[k], 9) for k in ((3, 9), (9, 3), (0, 1))}
    sketch = {(r.i, r.j): r.d for r in distances(df, "sequences", k=9, sketch_size=50, block=11).collect()}
    assert len(sketch) == 435 and max(sketch.values()) <= 1


def test_newick_round_trip(spark):
    text = "((a:0.1,'b c':2e-05)x:0.25,(d:0,e:3):1.5);"
    trees = spark.createDataFrame([(1, text), (2, "(a:1,b:2);")], "tree int, newick string")
    back = {r.tree: r.newick for r in files.trees_to_newick(files.trees_from_newick(trees)).collect()}
    assert back == {1: text, 2: "(a:1,b:2);"}
    with pytest.raises(ValueError):
        files.parse_newick("((a:1,b:2);")


def test_streamed_placements_equal_those_of_a_batch(spark, tmp_path):
    tips = Q.customer_tips(spark, DATA)
    rows = tips.orderBy("ord").limit(20).toPandas()
    base = Backbone(rows, Q.nested_metric)
    later = tips.where(F.col("ord") > int(rows["ord"].max()))
    later.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(later.schema).parquet(str(tmp_path / "in"))
    insert_stream(stream, base, Q.nested_metric, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda df: sorted((r.ord, r.edge, round(r.depth, 9)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(placements(later, base, Q.nested_metric))


def test_algorithm_by_size():
    assert [algorithm_for(n) for n in (10, 30_000, 1_000_000)] == ["nj", "k_closest", "divide"] and algorithm_for(2_000_000, "matrix") == "k_closest"


def test_nothing_else_imports_llm():
    import pathlib

    for path in pathlib.Path(__spark_entry__.__file__).parent.joinpath("cladespark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s+cladespark\.llm", path.read_text(), re.M), path
