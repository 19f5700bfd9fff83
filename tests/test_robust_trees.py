"""Distances that a model does not define, tips that are equal, and files with odd names."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladespark.operators import build as B
from cladespark.operators import distance as D
from cladespark.operators import placement as P
from cladespark.operators.build import build_tree, distances
from cladespark.operators.kernels import finite, neighbor_joining, path_lengths, place_all
from cladespark.plans import queries as Q
from cladespark.sources import files
from cladespark.sources.shared import materialized, temporary

DATA = "/root/testdata/sf0.001"


def a_tree(edges, n):
    nodes, children = {v for e in edges for v in e[:2]}, [c for c, *_ in edges]
    assert len(edges) == 2 * n - 2 and len(set(children)) == len(children) and len(nodes) == (2 * n - 1 if n > 1 else 0)
    assert len(nodes - set(children)) == (n > 1) and all(np.isfinite(x) for *_, x in edges)


@pytest.mark.parametrize("kind", ["nan", "inf", "some", "random", "negative", "zero"])
def test_any_matrix_gives_a_tree(kind):
    random = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 5, 9, 17):
        for _ in range(10):
            d = random.uniform(0, 2, (n, n))
            d = d + d.T
            holes = random.uniform(0, 1, (n, n)) < {"some": 0.2, "nan": 1.1, "inf": 1.1}.get(kind, 0)
            d[holes | holes.T] = np.inf if kind == "inf" else np.nan
            d = -d if kind == "negative" else 0 * d if kind == "zero" else d
            np.fill_diagonal(d, np.nan if kind == "nan" else 0.0)
            for edges in (neighbor_joining(d), place_all(d), place_all(d, None)):
                a_tree(edges, n)
    assert finite(np.array([[0, np.nan, 2.0], [np.nan, 0, 3.0], [2.0, 3.0, 0]])).tolist() == [[0, 3, 2], [3, 0, 3], [2, 3, 0]]


def joined_by_full_search(d):
    """Neighbor joining that looks at all pairs in every step: (nodes joined) as sets of tips, in order."""
    d, names, out = d.copy(), [frozenset([k]) for k in range(len(d))], []
    while len(names) > 2:
        m, u = len(names), d.sum(axis=1)
        q = d - (u[:, None] + u[None]) / (m - 2)
        np.fill_diagonal(q, np.inf)
        x, y = divmod(int(np.argmax(q <= q.min() + 1e-9)), m)
        out.append({names[x], names[y]})
        row = (d[x] + d[y] - d[x, y]) / 2
        d[x], d[:, x], d[x, x] = row, row, 0
        names[x] = names[x] | names[y]
        last = m - 1
        d[y], d[:, y], d[y, y], names[y] = d[last], d[:, last], 0, names[last]
        d, names = d[:last, :last].copy(), names[:last]
    return out


def test_bounded_search_joins_what_a_full_one_joins():
    random = np.random.default_rng(11)
    for n in (3, 8, 33, 70):
        for kind in range(3):
            x = random.uniform(0, 1, (n, 3))
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            if kind == 1:  # a cluster far from the rest
                d = d + 3 * (np.arange(n)[:, None] < n // 3) * (np.arange(n)[None] >= n // 3) + 3 * (np.arange(n)[:, None] >= n // 3) * (np.arange(n)[None] < n // 3)
            if kind == 2:  # ties
                d = np.round(2 * d)
            under, got = {k: frozenset([k]) for k in range(n)}, []
            edges = neighbor_joining(d)
            for (a, p, _), (b, *_) in zip(edges[::2], edges[1::2]):
                got.append({under[a], under[b]})
                under[p] = under[a] | under[b]
            assert got[:-1] == joined_by_full_search(d)


def random_sequences(spark, n, sites, seed):
    random = np.random.default_rng(seed)
    return spark.createDataFrame([(k, f"t{k}", "".join(random.choice(list("ACGT-"), sites)) if k % 5 else "-" * sites) for k in range(n)], "ord long, name string, seq string")


def test_trees_of_saturated_sequences(spark):
    """Unrelated sequences, where most models are undefined for some pair, and sequences without a base."""
    df = random_sequences(spark, 14, 60, 3)
    for model in D.MODELS:
        for compat in (False, True):
            for algorithm in ("nj", "place"):
                rows = build_tree(df, "alignment", algorithm, distance=model, formulas_as_written=compat).collect()
                a_tree([(r.node, r.parent, r.len) for r in rows if r.parent is not None], 14)
                assert sum(r.parent is None for r in rows) == 1
    rows = build_tree(df, "alignment", "divide", most=3, chunk=4).collect()
    a_tree([(r.node, r.parent, r.len) for r in rows if r.parent is not None], 14)


def test_settled_distances(spark):
    df = spark.createDataFrame([(0, "a", "ACGTACGT"), (1, "b", "CATGCATG"), (2, "c", "--------"), (3, "d", "ACGTACGT")], "ord long, name string, seq string")
    got = {(r.i, r.j): (r.d, r.defined) for r in distances(df, "alignment").collect()}
    assert got[1, 0] == (D.SATURATED, False) and got[3, 0] == (0.0, True)
    assert got[2, 0] == (D.SATURATED, False)  # eight mismatches with gaps: p = 1
    got = {(r.i, r.j): (r.d, r.defined) for r in distances(df, "alignment", distance="tn", formulas_as_written=True).collect()}
    assert got[3, 0] == (0.0, False)  # equal sequences, which that form does not define
    cells = spark.createDataFrame([(1, 0, 1.0), (2, 0, float("nan")), (3, 0, 4.0), (3, 1, float("inf"))], "i int, j int, d double")
    rows = build_tree(cells, "matrix", "nj", names=df.select(F.col("ord").alias("i"), "name")).collect()
    a_tree([(r.node, r.parent, r.len) for r in rows if r.parent is not None], 4)


def test_equal_tips_are_placed_once(spark, monkeypatch):
    """Rounds do not grow with the number of equal tips, and the tree has the path lengths of all."""
    tips = Q.customer_tips(spark, DATA).select("ord", F.lit(0.0).alias("p"), "e", "r", "inner_", "outer_", F.col("inner_").alias("same"))
    more = tips.unionByName(tips.withColumn("ord", F.col("ord") + 7_000_000_000_000_000)).withColumn("turn", F.xxhash64("ord"))
    rounds = []
    real = P._round
    monkeypatch.setattr(P, "_round", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(P, "IN_A_ROW", 5)
    for every in (tips, more):
        rows = every.toPandas()
        rounds.clear()
        edges = [tuple(r) for r in P.place_tips(every, Q.nested_metric, begin=4, most=4, chunk=9, compat=False, content="same").collect()]
        a_tree(edges, len(rows))
        assert len(rounds) <= 6
        want = Q.nested_metric(rows, rows)
        assert np.allclose(path_lengths(edges, rows["ord"].tolist()), want)
    one = tips.limit(9).withColumns({"inner_": F.lit(1), "outer_": F.lit(1), "same": F.lit("x")})
    a_tree([tuple(r) for r in P.place_tips(one, Q.nested_metric, content="same").collect()], 9)


def test_alike_tips_are_placed_once(spark, monkeypatch):
    """Rounds do not grow with the number of tips that agree in all that distances follow from; path lengths and the root are those of all."""
    tips = Q.customer_tips(spark, DATA)
    many = [tips.withColumn("ord", F.col("ord") + k * 7_000_000_000_000_000) for k in range(3)]
    more = many[0].unionByName(many[1]).unionByName(many[2])
    first = tips.orderBy("ord").limit(1).withColumn("ord", F.lit(1).cast("long"))  # now the first two tips are alike
    rounds, real = [], P._round
    monkeypatch.setattr(P, "_round", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(P, "IN_A_ROW", 3)
    for every in (more, more.unionByName(first)):
        rows = every.toPandas().sort_values("ord", ignore_index=True)
        rounds.clear()
        edges = [tuple(r) for r in P.place_tips(every, Q.nested_metric, begin=4, most=4, chunk=9, compat=False, alike=Q.ALIKE).collect()]
        a_tree(edges, len(rows))
        assert len(rounds) <= 6
        want, root = Q.nested_metric(rows, rows), (({p for _, p, _ in edges}) - {c for c, *_ in edges}).pop()
        got = path_lengths(edges, [*rows["ord"].tolist(), root])
        assert np.allclose(got[:-1, :-1], want)
        assert np.allclose(got[-1, :-1], np.maximum(want[0], want[1]) - want[0, 1] / 2)


def test_equal_sequences_in_divide_and_conquer(spark):
    random = np.random.default_rng(2)
    own = ["".join(random.choice(list("ACGT"), 80)) for _ in range(12)]
    df = spark.createDataFrame([(k, f"t{k}", own[0] if k % 4 else own[k // 4 % 12]) for k in range(160)], "ord long, name string, seq string")
    for kind in ("alignment", "sequences"):
        rows = build_tree(df, kind, "divide", k=7, sketch_size=40, most=5, chunk=8).collect()
        a_tree([(r.node, r.parent, r.len) for r in rows if r.parent is not None], 160)
        assert sorted(r.name for r in rows if r.name) == sorted(f"t{k}" for k in range(160))


def test_matrix_of_sequences_named_by_numbers(spark, tmp_path):
    (tmp_path / "m.phy").write_text("3\n101\n102\t0.5\n103\t0.25\t0.75\n")
    names, cells = files.read_phylip_matrix(spark, str(tmp_path / "m.phy"))
    assert sorted((r.i, r.name) for r in names.collect()) == [(0, "101"), (1, "102"), (2, "103")]
    assert sorted(tuple(r) for r in cells.collect()) == [(1, 0, 0.5), (2, 0, 0.25), (2, 1, 0.75)]
    (tmp_path / "bare.phy").write_text("x\ny\t2\n")
    assert files.read_phylip_matrix(spark, str(tmp_path / "bare.phy"))[0].count() == 2


def test_odd_names_in_newick(spark):
    names = ["o'neil", "it''s", "a[b]", "(x)", "tab\there", "", "plain", "semi;colon", "'"]
    rows = [(0, None, None, None), *((k + 1, 0, name, 0.5) for k, name in enumerate(names))]
    text = files.newick_of(rows)
    assert files.parse_newick(text) == rows
    assert [r[2] for r in files.parse_newick("('it''s':1,b[a comment, (with [nested] signs)]:2[&x],c:[y]3)r[z];")] == ["r", "it's", "b", "c"]
    assert files.parse_newick("(a:1,c:[y]3);")[2][3] == 3.0
    for broken in ("(a,b[c;", "('a,b);", "(a,b"):
        with pytest.raises(ValueError):
            files.parse_newick(broken)


def test_tables_of_others_stay(spark):
    """What another thread writes inside a block is not deleted with it, and nested blocks delete their own."""
    kept = []

    def other():
        kept.append(materialized(spark.range(3), "other"))

    with temporary(spark) as keep:
        mine, last = materialized(spark.range(4), "mine"), materialized(spark.range(5), "last")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        with temporary(spark):
            inner = materialized(spark.range(6), "inner")
        keep.append(last.written_to)
    assert kept[0].count() == 3 and last.count() == 5
    for gone in (mine, inner):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND"):
            spark.read.parquet(gone.written_to).count()


def test_equal_rows_of_a_matrix_are_joined_once(spark, monkeypatch):
    """A matrix of more rows than one task joins: rows that differ by the distance between them only are one, and path lengths are those of all."""
    tips = Q.customer_tips(spark, DATA).select("p", "e", "r", "inner_", "outer_").limit(40).toPandas()
    rows = pd.concat([tips, tips, tips], ignore_index=True)
    rows["ord"] = np.random.default_rng(1).permutation(len(rows))
    rows = rows.sort_values("ord", ignore_index=True)
    d = Q.nested_metric(rows, rows)
    d = (d + d.T) / 2
    sizes, real = [], B.hung
    monkeypatch.setattr(B, "hung", lambda edges, *a: sizes.append(edges.count()) or real(edges, *a))
    cells = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(120) for j in range(i)], "i int, j int, d double")
    names = spark.createDataFrame([(i, f"t{i}") for i in range(120)], "i int, name string")
    for algorithm in ("nj", "place", "auto"):
        edges = [(r.node, r.parent, r.len) for r in B.build_tree(cells, "matrix", algorithm, names=names, joined=60, compat=False).collect() if r.parent is not None]
        a_tree(edges, 120)
        assert np.allclose(path_lengths(edges, [*range(120)]), d)
    assert len(sizes) == 3 and max(sizes) <= 2 * 41
    # classes that meet beyond the root, on the edge of another class too: two kinds of tips, one with longer edges
    for longer in (0.01, 0.5):
        two = pd.DataFrame({"ord": range(8), "p": [longer, 0.1] * 4, "e": 0.0, "r": 0.0, "inner_": 1, "outer_": 1})
        edges = [tuple(r) for r in P.place_tips(spark.createDataFrame(two), Q.nested_metric, compat=False, alike=Q.ALIKE).collect()]
        a_tree(edges, 8)
        root = ({p for _, p, _ in edges} - {c for c, *_ in edges}).pop()
        assert np.allclose(path_lengths(edges, [*range(8)]), Q.nested_metric(two, two))
        assert np.allclose(path_lengths(edges, [root, 0, 1])[0, 1:], (longer + 0.1) / 2)
    # of few rows all are joined, and a different cell keeps rows apart
    B.build_tree(cells, "matrix", "nj", names=names).count()
    B.build_tree(cells.withColumn("d", F.col("d") + F.col("i") * F.col("j") * 1e-9), "matrix", "nj", names=names, joined=60).count()
    assert len(sizes) == 3
