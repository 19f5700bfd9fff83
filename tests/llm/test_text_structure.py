"""Periodic runs, spelling variants and repeated passages against brute force and SQL."""

import hashlib
import random

import duckdb
import numpy as np

from cladespark.llm import periodic_runs, repeats, spelling

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, query, sql, where=DATA):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet{'' if where == DATA else '/*.parquet'}'")
    got, want = query(spark, where), con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def brute_runs(words, times=4, least=6):
    found = {}
    for q in range(1, len(words) // times + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i < len(words) - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(least, times * q):
                    found.setdefault((start, i - start + q), q)
                start = None
    return sorted((a, n, q) for (a, n), q in found.items())


def test_runs_against_all_periods():
    """Words appended in portions of any size give the runs that a search over all periods and places gives."""
    rng, seen = random.Random(3), 0
    for _ in range(1500):
        n, letters = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 4:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
                length = rng.randint(1, n - a)
                words[a : a + length] = [words[a + i % p] for i in range(length)]
        want = brute_runs(words)
        seen += len(want)
        for portion in (1000, 1, rng.randint(2, 20)):
            assert periodic_runs.runs_of(words, portion=portion) == want
    assert seen > 1000
    for words, want in ((["a"] * 30_000, (0, 30_000, 1)), (["a", "b"] * 10_000, (0, 20_000, 2)), ([*range(700)] * 9, (0, 6300, 700))):
        assert periodic_runs.runs_of(words) == [want]


def test_collapsed_text():
    words = "x a b a b a b a b y y y y y y z".split()
    runs = periodic_runs.runs_of(words)
    assert runs == [(1, 8, 2), (9, 6, 1)] and periodic_runs.collapsed(words, runs) == "x a b y z".split()
    assert periodic_runs.collapsed([], []) == []


def test_runs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a " * 6), (5, "a a " * 6), (None, "one two " * 40_000)]
    docs = spark.createDataFrame([(*r, "mine", "other") for r in rows], "doc_id long, text string, runs string, `a.b` string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r["a.b"]) for r in periodic_runs.with_runs(docs).collect()]
    nothing = (0, [], "", "other")
    assert sorted(got, key=repr) == sorted(
        [(1, *nothing), (2, *nothing), (3, *nothing), (4, 5, [], "a a a a a", "other"), *2 * [(5, 6, [(0, 6, 1)], "a a", "other")], (None, 80_000, [(0, 80_000, 2)], "one two", "other")], key=repr
    )


def test_op13_against_sql_and_brute_force(spark, tmp_path):
    same_as_sql(spark, periodic_runs.op13_periodic_runs, periodic_runs.ORACLES["op13_periodic_runs"])
    rows = [(i, None if i % 50 == 7 else " ".join(random.Random(i).choices("ab cd ef".split(), k=i % 60)), "en") for i in range(300)]
    spark.createDataFrame([*rows, rows[10], (None, "a " * 9, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, periodic_runs.op13_periodic_runs, periodic_runs.ORACLES["op13_periodic_runs"], str(tmp_path))
    for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        words = periodic_runs.planted((rows[r.doc_id][1] or "").split(), r.doc_id)
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))): rng.choice([1, 2, 5, 5, 25, 130, 700]) for _ in range(400)}
    rows = [*made.items(), (None, 9), ("\U0001f600x", 1), ("\U0001f601x", 5), ("x" * 3000, 1), ("x" * 3001, 6)]
    words = dict(r for r in rows if r[0] is not None)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(*r, "k") for r in rows], "word string, n int, key string")).collect()}
    assert got.keys() == words.keys()
    form = {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if others and words[best] >= 5 * n else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(others), form[w], words.get(form[w])), w
    longest = 0
    for w in words:
        root, steps = w, 0
        while form[root] is not None:
            root, steps = form[root], steps + 1
        longest = max(longest, steps)
        assert got[w].root == root
    assert longest > 2


def test_op11_against_sql(spark, tmp_path):
    same_as_sql(spark, spelling.op11_spelling_variants, spelling.ORACLES["op11_spelling_variants"])
    rng = random.Random(1)
    stems = ["Schlüsselé", "straßengraben", "ähnlichkeit", "abcabcabc", "çonséquence", "short", "sixlet"]
    rows = [(None if i % 9 == 0 else i, None if i % 50 == 3 else " ".join(rng.choice(stems) + rng.choice([*20 * [""], "e", "E", ".", "1x"]) for _ in range(i % 30)), "k") for i in range(400)]
    spark.createDataFrame([*rows, rows[29], (5, "lang" * 5000, "k")], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, spelling.op11_spelling_variants, spelling.ORACLES["op11_spelling_variants"], str(tmp_path))
    assert spelling.op11_spelling_variants(spark, str(tmp_path)).where("form IS NOT NULL").count() > 0


def brute_repeats(rows):
    """(doc_id, words) of each row -> the words that stay."""
    first = {}
    for doc, words in rows:
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in rows:
        gone = {j for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < doc for j in range(i, i + 50)}
        out.append([w for j, w in enumerate(words) if j not in gone])
    return out


def repeating_rows(seed):
    """Documents of passages that others have, cut anywhere, beside runs of one word, of few words and of random ones."""
    rng = random.Random(seed)
    word = lambda k: f"w{rng.randrange(k)}"
    passages = [[word(10**6) for _ in range(rng.randint(45, 400))] for _ in range(12)]
    passages += [["a"] * 180, ["a", "b", "c"] * 60, [word(2) for _ in range(300)], [word(4) for _ in range(200)], ["x", "x", "y"] * 40]
    rows = []
    for doc in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [word(10**6) for _ in range(rng.choice([0, 0, 1, 7, 60]))]
            p = rng.choice(passages)
            a = rng.choice([0, rng.randrange(len(p))])
            words += p[a : rng.choice([len(p), a + rng.randint(40, 60), a + rng.randint(48, 52)])]
        rows.append((doc, words))
    return [*rows, (7, rows[3][1]), (8, rows[8][1]), (8, rows[8][1]), (200, rows[9][1]), (201, rows[9][1])]


def test_repeats_against_all_windows(spark):
    for seed in range(3):
        rows = repeating_rows(seed)
        docs = spark.createDataFrame([(d, " ".join(w), "k") for d, w in rows], "doc_id long, text string, row string").repartition(3)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeated_passages(docs).collect())
        kept = brute_repeats(rows)
        want = sorted((d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, w), k in zip(rows, kept))
        assert got == want and sum(r[2] > 0 for r in got) > 50 and any(0 < r[2] < r[1] for r in got)


def test_equal_windows_have_equal_keys():
    """Whatever stands around a window, and symbols that windows are known by follow from the words inside."""
    rng = np.random.default_rng(1)
    for letters in (2, 3, 50, 10**9):
        passage = rng.integers(0, letters, 90).astype(np.uint64)
        docs = [np.concatenate([rng.integers(0, letters, rng.integers(0, 40)), passage, rng.integers(0, letters, rng.integers(0, 40))]).astype(np.uint64) for _ in range(20)]
        docs[3] = passage
        made = repeats.Recompressed(docs)
        own = dict(zip(made.windows.tolist(), zip(made.keys().tolist(), made.content(made.windows, made.windows + 50).tolist())))
        seen = []
        for d, start in zip(docs, made.starts.tolist()):
            at = next(i for i in range(len(d)) if np.array_equal(d[i : i + 90], passage))
            seen.append([own[start + at + k] for k in range(41)])
        assert all(s == seen[0] for s in seen) and len(own) == sum(len(d) - 49 for d in docs)


def test_texts_in_portions_are_the_same(spark, monkeypatch):
    texts = [" ".join(w) for _, w in repeating_rows(9)] + [None, "", " \n"]
    whole = repeats.in_portions(texts, 1, lambda words, _: [(w,) for w in words])
    monkeypatch.setattr(repeats, "AT_ONCE", 100)
    assert repeats.in_portions(texts, 1, lambda words, _: [(w,) for w in words]) == whole and repeats.in_portions([], 2, None) == [[], []]


def test_op12_against_sql(spark, tmp_path):
    same_as_sql(spark, repeats.op12_substring_dedup, repeats.ORACLES["op12_substring_dedup"])
    rows = [(d, " ".join(w), "k") for d, w in repeating_rows(4)]
    long = " ".join(f"q{i % 4000}" for i in range(25_000))
    odd = [(None, rows[3][1], "k"), (None, rows[3][1], "k"), (None, long, "k"), (None, long + " z", "k"), (500, None, "k"), (501, "", "k"), (502, " \n\t", "k"), (503, long, "k"), (504, "é\u00a0b " * 100, "k"), (505, "é\u00a0b " * 70, "k")]
    spark.createDataFrame([*rows, *odd], "doc_id long, text string, found string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, repeats.op12_substring_dedup, repeats.ORACLES["op12_substring_dedup"], str(tmp_path))
