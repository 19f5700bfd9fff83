"""Sketches of sequences in pieces, and of hashes that occur often."""

from collections import Counter

import numpy as np
import pytest

from cladespark.operators import sketch as S


@pytest.mark.parametrize("dedup", [False, True])
def test_sketches_in_pieces(spark, monkeypatch, dedup):
    """However a sequence is cut, its sketch is that of the whole; so are those of frequent hashes."""
    random = np.random.default_rng(1)
    texts = ["".join(random.choice(list("ACGT"), n)) for n in (0, 3, 8, 9, 40, 41, 700, 3000)] + ["ACG" * 300, None, "A" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    monkeypatch.setattr(S, "MERGED", 3)
    for piece in (7, 33, 10_000):
        for least in (1, 2, 3):
            got = {r.seq_id: r for r in S.sketches(df, 8, 50, dedup=dedup, piece=piece, least=least).collect()}
            assert len(got) == len(texts)
            for k, text in enumerate(texts):
                h = S.sequence_hashes(text or "", 8).tolist()
                often = Counter(h)
                kept = sorted(x for x in (set(h) if dedup else h) if often[x] >= least)
                assert (got[k].n_kmers, got[k].sketch) == (len(h), kept[:50]), (piece, least, k)


def sequence_table(spark, n, seed):
    """Mutated copies of a few sequences, some of them long, short or empty, under ids that are not in a row."""
    random = np.random.default_rng(seed)
    base = ["".join(random.choice([*"ACGT"], 90)) for _ in range(4)]
    rows = []
    for k in range(n):
        own = np.where(random.uniform(size=90) < 0.03 * (k % 5), random.choice([*"ACGT"], 90), [*base[k % 4]])
        rows.append((3 * k, "".join(own)[: (90, 60, 8, 0)[min(3, k % 11)] if k % 11 < 4 else 90] * (1 if k % 7 else 4)))
    return rows, spark.createDataFrame(rows, "seq_id long, seq string")


def test_search_in_portions(spark, monkeypatch):
    """The nearest among all, ties included, whatever the portions are; no table that is written has a row for each shared hash or a sketch of a short sequence."""
    rows, df = sequence_table(spark, 60, 4)
    k, size = 9, 40
    own = {i: np.unique(S.sequence_hashes(s, k))[:size] for i, s in rows}
    want = set()
    for i in list(own)[::3]:
        near = []
        for j in own:
            if j != i:
                shared = S.shared_hashes(own[i], own[j], size, False)
                held = size if shared == 0 else min(size, len(np.union1d(own[i], own[j])))
                near.append((round(S.mash_distance(shared, held, k), 9), j, shared))
        want |= {(i, j, shared, d, r + 1) for r, (d, j, shared) in enumerate(sorted(near)[:5])}
    tables, real = [], S.materialized
    monkeypatch.setattr(S, "materialized", lambda t, name: tables.append(real(t, name)) or tables[-1])
    monkeypatch.setattr(S, "TOGETHER", 4)
    monkeypatch.setattr(S, "KEPT", 8)
    asked = spark.createDataFrame([(i,) for i in list(own)[::3]], "seq_id long")
    for portions in ({}, {"asked": 6, "searched": 11}):
        for letters in (8, 1):
            monkeypatch.setattr(S, "LETTERS", letters)
            got = {tuple(r) for r in S.mash_search(asked, df, k, size, 5, **portions).select("i", "j", "shared", "d", "rank").collect()}
            assert {(*t[:3], round(t[3], 9), t[4]) for t in got} == want
    assert max(t.count() for t in tables) <= 60 * 20
    assert not any("sketch" in t.columns and t.where("seq IS NOT NULL AND sketch IS NOT NULL").head(1) for t in tables)


def test_pairs_that_share_one_hash_are_as_far_as_those_that_share_none(spark):
    """The smaller ids come first among them."""
    random = np.random.default_rng(8)
    text = ["".join(random.choice([*"ACGT"], 60)) for _ in range(20)]
    text = [*text[:19], text[19][:-9] + text[0][:9]]
    df = spark.createDataFrame(list(enumerate(text)), "seq_id long, seq string")
    got = [(r.j, r.shared) for r in S.mash_search(spark.createDataFrame([(0,)], "seq_id long"), df, 9, 20, 3).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 0), (3, 0)]


def test_given_pairs_in_blocks(spark, monkeypatch):
    """Pairs are compared in tasks of blocks of ids, to which each sequence goes once, as a sequence if it is shorter than a sketch."""
    rows, df = sequence_table(spark, 40, 6)
    pairs = spark.createDataFrame([(i, i + d) for i, _ in rows for d in (3, 6, 60)] + [(9, 0)], "i long, j long")
    for dedup in (False, True):
        want = {(r.i, r.j): (r.shared, round(r.d, 9)) for r in S.mash_pairs(pairs, S.sketches(df, 9, 40, dedup=dedup), 9, 40, dedup).collect()}
        for letters in (8, 1):
            monkeypatch.setattr(S, "LETTERS", letters)
            got = {(r.i, r.j): (r.shared, round(r.d, 9)) for r in S.mash_given(pairs, df, 9, 40, dedup, ids=16).collect()}
            assert got == want and len(got) > 80


def test_hashes_of_others_are_put_in_order_once(monkeypatch):
    """Sketches with repetitions, some of them empty, against a list whose hashes are sorted once: what each pair gives by itself."""
    random = np.random.default_rng(3)
    for top, size in ((30, 12), (400, 25), (60, 60)):
        some = [np.sort(random.integers(0, top, int(n))) for n in random.integers(0, size + 1, 23)]
        crossed = S.Crossed(some, size)
        for x in (some[:9], some[9:10], [np.zeros(0, np.int64)]):
            first = random.uniform(size=(len(x), 23)) < 0.5
            want = [[S.shared_hashes(a, b, size) if f else S.shared_hashes(b, a, size) for b, f in zip(some, row)] for a, row in zip(x, first)]
            assert crossed.shared(x, first).tolist() == want
    assert S.Crossed([], 5).shared(some[:2], np.zeros((2, 0), bool)).shape == (2, 0)
