import base64
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cladespark.llm import bpe, chat, common, decontamination, near_dup, quality_classifier, quality_rules, registry, secrets, sketch, token_counts, toxicity, warc
from cladespark.llm.common import held_out, materialized, without
from cladespark.llm.components import components

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
#: Nulls, empty and very long texts, ties and repeated rows; more columns, with clashing names.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, score string, __at string"


def odd_documents(spark):
    long_text = " ".join(f"word{i % 4000}" for i in range(30_000))
    rows = [(1, None, None, None), (None, "some text here without an id at all, longer than ten words", "en", "a"), (2, "", "en", None), (3, long_text, None, "b"), (4, "x", "en", "a"), (4, "x", "en", "a"), (5, " \n\t ", "en", "a"), (6, "é" * 50_000, "fr", "c"), (7, "token = abcdefghijklmnop AKIA" + "A" * 20, "en", "a"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 1, "t", "k", "s", "at") for r in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    odd_documents(spark).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, None, None), (3, 1, 0), (6, 0, 1), (7, 1, 1), (7, 1, 1), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (3, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (None, "some text here without an id at all longer")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "a<|b"), (1, 1, "assistant", "<|im_end|>"), (1, None, "us\ner\\n", "z"), (None, 0, "user", ""), (1, 1, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string").write.parquet(f"{where}/conversations.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://WWW.a.com:80/x/?utm_a=1&b=2#f", "h"), (2, "http://a.com/x?b=2", ""), (None, "http://a.com", "q")], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{odd_dir}/{t}.parquet").where("false").write.parquet(f"{where}/{t}.parquet")
    return where


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, odd_dir, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == (1 if name == "op4_chat" else 0)
    rows = registry.QUERIES[name](spark, odd_dir).collect()
    assert len(rows) == 10 or name in ("op2_decontamination", "op3_warc", "op4_chat", "op11_spelling_variants")


def test_portions_by_rows_and_bytes():
    for values in (pa.array(["x" * k for k in (3, 1 << 20, 5, 0)] * 300 + [None] * 700), pa.array([[1] * 1000, None] * 400), pa.array([{"a": "y" * 5000, "b": 1}, None] * 600), pa.array([], pa.string())):
        cut = [*common.portions(values)]
        assert [s for s, _ in cut] == [sum(n for _, n in cut[:k]) for k in range(len(cut))] and sum(n for _, n in cut) == len(values)
        sizes = common._bytes(values)
        assert all(n <= common.ROWS and (n == 1 or sizes[s : s + n].sum() <= common.BYTES) for s, n in cut)
        assert len(cut) <= 2 + 2 * sizes.sum() // common.BYTES + len(values) // 250


CLASHES = ("__at", "__row", "__maybe", "__words", "doc", "key", "kept", "score", "n_tokens", "script", "features", "size", "again", "held", "text1", "a.b")


def test_pipeline_on_odd_and_empty_tables(spark, odd_dir, empty_dir):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(c) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialized(stage(spark, docs, odd_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES] and all(r[c] == c for r in docs.collect() for c in CLASHES), name
    assert all(r.round_trip for r in corpus_pipeline.bpe(spark, docs, odd_dir).collect())
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_stages_on_rows_without_id_and_repeated_rows(spark, odd_dir):
    words = [f"w{i}" for i in range(120)]
    near, other = " ".join(words[:119] + ["z"]), " ".join(f"o{i}" for i in range(120))
    leaked = "before word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 after"
    rows = [(None, " ".join(words)), (None, near), (None, other), (None, other), (7, other + " more"), (8, leaked), (None, leaked), (9, "x y"), (9, "x y"), (10, None), (11, ""), (None, None), (12, leaked + " and token = abcdefghijklmnop")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, at string")
    left = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, odd_dir).collect())
    groups = [r for r in left if r[1] in (" ".join(words), near)]
    assert len(groups) == 1 and groups[0][0] == 0  # one of two near copies without an id
    assert (0, other) not in left and (7, other + " more") in left and (8, leaked) in left and (0, leaked) not in left
    assert left.count((9, "x y")) == 1 and (10, "") in left and (11, "") in left and (0, "") in left
    clean = corpus_pipeline.decontamination(spark, docs, odd_dir)
    assert sorted(int(r["at"]) for r in clean.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    masked = {r["at"]: r for r in corpus_pipeline.secret_scan(spark, docs, odd_dir).collect()}
    assert masked["12"].text == leaked + f" and {secrets.MASK}" and masked["12"].n_chars == len(masked["12"].text) and masked["9"].n_chars is None
    assert all(masked[str(k)].text == t for k, (_, t) in enumerate(rows[:12]))
    kept = sorted(int(r["at"]) for r in corpus_pipeline.quality_rules(spark, docs, odd_dir).collect())
    assert set(kept).isdisjoint({7, 8, 9, 10, 11}) and {2, 3} <= set(kept)


def test_stages_send_few_rows_and_bytes_to_python_at_once(spark, odd_dir, monkeypatch):
    """What the operators of the stages would send in one batch, on short and on long texts; the session's settings hold again afterwards."""
    most = {}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    def watched(name, result):
        def run(rows, *args, **named):
            most[name] = rows.mapInArrow(sizes, "n long, size long").agg(F.max("n"), F.max("size")).first()
            return result(rows)

        monkeypatch.setattr(corpus_pipeline, name, run)

    watched("judge", lambda rows: rows.withColumn("kept", F.lit(True)))
    watched("near_duplicates", lambda rows: rows.select(F.col("key").alias("doc_id"), F.lit(True).alias("kept")))
    watched("leaks", lambda rows: rows.where("false"))
    watched("encode_and_check", lambda rows: rows.withColumn("ids", F.array(F.lit(1))).withColumn("round_trip", F.lit(True)))
    text = F.when(F.col("id") < 1200, F.lit("short")).otherwise(F.repeat(F.lit("long text "), 30_000))
    docs = materialized(spark.range(0, 1250, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang")), "few").coalesce(1)
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    spark.conf.set(names[0], "777")
    try:
        before = [spark.conf.get(x) for x in names]
        for name, stage in corpus_pipeline.STAGES:
            if name != "secret_scan":  # no Python there
                assert stage(spark, docs, odd_dir).count() == 1250
                assert [spark.conf.get(x) for x in names] == before
    finally:
        spark.conf.unset(names[0])
    assert len(most) == 4 and all(n <= 500 and size < 4 << 20 for n, size in most.values()), most


def test_pipeline_against_brute_force(spark):
    """The whole run on sf0.001, each stage again by plain Python."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rules = {r.doc_id for r in quality_rules.op6_quality_rules(spark, DATA).where("kept").collect()}  # tested above
    texts = {i: docs[i].text for i in rules}
    texts = {i: texts[i] for i, (_, c) in brute_components([*texts.items()], 80).items() if c == i}
    items = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(holds(decontamination.words_of(t), x) for x in items)}
    kinds = [(re.compile(secrets.PATTERNS["assign"]), 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16)]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got.keys() == texts.keys() and all(r.round_trip for r in got.values())
    for i, text in texts.items():
        spans = sorted(m.span() for p, g, least in kinds for m in p.finditer(text) if len(m[g]) >= least)
        if not spans and not re.search(secrets.PATTERNS["owned"], text):
            assert got[i].ids == library.encode(text, add_special_tokens=False).ids and got[i].n_chars == len(text)
        else:
            plain = library.decode(got[i].ids, skip_special_tokens=False)
            assert got[i].n_chars == len(plain) and not any(text[a:b] in plain for a, b in spans)


def holds(doc, item):
    """Is some stretch of the document within the allowed edits of the item? One row of the edit table for each of its words."""
    doc, at, row = np.array(doc, object), np.arange(len(doc) + 1), np.zeros(len(doc) + 1, int)
    for i, x in enumerate(item, 1):
        row = np.concatenate([[i], np.minimum(row[:-1] + (doc != x), row[1:] + 1)])
        row = np.minimum.accumulate(row - at) + at
    return bool(item) and row.min() <= decontamination.allowed(len(item))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


# --- 1: toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    terms = {"idiot": 2.0, "worthless": 3.0, "scum": 1.0, "disgustingly": 1.5, "idea": 0.5}
    lexicon, pick = toxicity.FuzzyLexicon(terms), random.Random(1)
    for _ in range(3000):
        word = list(pick.choice([*terms, "other"]))
        for _ in range(pick.randint(0, 3)):
            at = pick.randrange(len(word) + 1)
            word[at : at + pick.randint(0, 1)] = pick.choice("adiostx") * pick.randint(0, 1)
        word = "".join(word) or "x"
        near = [(edits(word, t), -w, t) for t, w in terms.items() if edits(word, t) <= toxicity.allowed(t)]
        assert lexicon.match(word) == ((min(near)[2], min(near)[0]) if near else None), word


def test_quotation_weakens_hits():
    scorer = toxicity.Scorer({"idiot": 2.0})
    plain, quoted, said = (scorer.features(t)[0] for t in ("you idiot go away", 'he wrote "you idiot" there', "they said idiot there"))
    assert plain[5] == 0 and quoted[5] == 1 and said[5] == 1 and quoted[4] < plain[4]
    assert scorer.hits("an idiott, an IDIOT.")[1][1:3] == ("idiot", 0)


def test_terms_against_plain_counts(spark):
    pick = random.Random(15)
    rows = []
    for i in range(400):
        y = int(i % 4 == 0)
        words = [pick.choice("the a of and to in it".split()) for _ in range(20)] + (["scum"] if y and pick.random() < 0.7 else []) + (["rare"] if i < 3 else []) + (["both"] if pick.random() < 0.5 else [])
        rows.append((i, " ".join(words) + ".", y))
    got = dict(toxicity.learn_terms(spark.createDataFrame(rows, "doc_id long, text string, y int")))
    ones, zeros, sets = 100, 300, [({w.strip(toxicity.EDGES) for w in t.lower().split()}, y) for _, t, y in rows]
    words, told = set().union(*(s for s, _ in sets)), {}
    for w in words:
        p, q = sum(w in s and y for s, y in sets), sum(w in s and not y for s, y in sets)
        null, n = toxicity.LIFT * ones / (toxicity.LIFT * ones + zeros), p + q
        evidence = (p * np.log(p / n / null) if p else 0) + (q * np.log(q / n / (1 - null)) if q else 0)
        if p / n > null:
            told[w] = np.floor(100 * evidence) / 100, round(float(np.log((p + 0.5) / (ones + 1)) - np.log((q + 0.5) / (zeros + 1))), 6)
    enough = [e for e, _ in told.values() if e >= np.log(len(words) / (toxicity.ALPHA * sum(x >= e for x, _ in told.values())))]
    assert got == pytest.approx({w: odds for w, (e, odds) in told.items() if e >= min(enough)}) and set(got) == {"scum"}


def test_features_against_plain_loops():
    terms = {"idiot": 2.0, "worthless": 3.0, "scum": 1.0}
    scorer, pick = toxicity.Scorer(terms), random.Random(16)
    pool = ["idiot", "Idiot!", "idiott", "worthles", "WORTHLESS", "scum", "scun", '"', '"scum"', "wrote", "you", "are", "a", "fine", "person,"]
    for _ in range(300):
        text = " ".join(pick.choices(pool, k=pick.randint(0, 40)))
        words, hits = text.lower().split(), []
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        marks = [i for i, c in enumerate(text) if c == '"']
        for k, w in enumerate(words):
            bare = w.strip(toxicity.EDGES)
            near = [(edits(bare, t), -v, t) for t, v in terms.items() if edits(bare, t) <= toxicity.allowed(t)]
            if near:
                at = starts[k] + len(w) - len(w.lstrip(toxicity.EDGES))
                before = sum(m < at for m in marks)
                reported = any(x.strip(toxicity.EDGES) in toxicity.REPORTING for x in words[max(0, k - 3) : k])
                hits.append((k, min(near)[2], min(near)[0], before % 2 == 1 and before < len(marks) or reported))
        value = {k: terms[t] * (1 if e == 0 else 0.5) * (toxicity.QUOTED if q else 1) for k, t, e, q in hits}
        got, n = scorer.features(text)
        assert n == len(hits)
        if hits:
            windows = [sum(v for j, v in value.items() if abs(j - k) <= toxicity.WINDOW) for k in value]
            exact, rough = [terms[t] for _, t, e, _ in hits if e == 0], [terms[t] for _, t, e, _ in hits if e]
            want = [1, np.log1p(sum(exact)), np.log1p(sum(rough)), np.log1p(len({t for _, t, e, _ in hits if e == 0})), np.log1p(max(windows)), sum(q for *_, q in hits) / len(hits), np.log1p(100 * sum(value.values()) / len(words)), max(exact, default=0)]
            assert got == pytest.approx(want)


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "you idiot", "mine", "old")], "doc_id long, text string, features string, score string")
    r = toxicity.with_score(df, toxicity.Model((("idiot", 2.0),), (1.0,) + (0.0,) * toxicity.FEATURES)).first()
    assert r.features == "mine" and r.n_hits == 1 and r.score == pytest.approx(1 / (1 + np.exp(-1)))


def test_partition_sums_equal_a_direct_solution(spark):
    random_ = np.random.default_rng(17)
    x, y = random_.normal(size=(300, quality_classifier.STATS)), random_.integers(0, 2, 300)
    rows = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "stats array<double>, y int").repartition(quality_classifier.FAN_IN * 2 + 3)
    mean, scale = x.mean(0), x.std(0)
    a, b = quality_classifier.normal_equations(rows, mean, scale)
    z = quality_classifier.fourier(x, mean, scale)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)
    # products of the features approximate the Gaussian kernel of the standardised statistics
    u = (x[:60] - mean) / scale
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / (2 * quality_classifier.STATS))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - kernel).mean() < 0.06


@pytest.mark.parametrize("query,label,least", [(toxicity.op1_toxicity, "toxic", 0.93), (quality_classifier.op9_quality_classifier, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    d = "/root/testdata/sf0.01"
    got = query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() >= least and got["score"].between(0, 1).all()


def test_no_held_out_label_is_learnt(spark, tmp_path):
    d, where = "/root/testdata/sf0.001", str(tmp_path)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    spark.read.parquet(f"{d}/documents.parquet").write.parquet(f"{where}/documents.parquet")
    labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}).write.parquet(f"{where}/labels.parquet")
    for query in (toxicity.op1_toxicity, quality_classifier.op9_quality_classifier):
        a, b = ({r.doc_id: r.score for r in query(spark, x).collect()} for x in (d, where))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_isotonic():
    assert quality_classifier.isotonic(np.array([1.0, 3, 2, 2, 5]), np.ones(5)).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])


# --- 2: decontamination


def nearest_passage(item, doc):
    """Word edits of the nearest of all stretches of the document, each compared by itself."""
    longest = len(item) + decontamination.allowed(len(item))
    return min(edits(item, doc[i:j]) for i in range(len(doc) + 1) for j in range(i, min(len(doc), i + longest) + 1))


def test_leaks_against_every_passage(spark):
    pick = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[pick.choice(vocabulary) for _ in range(n)] for n in (1, 2, 5, 6, 7, 7, 8, 9, 13, 20, 27, 40)]
    docs = []
    for i in range(40):
        doc = [pick.choice(vocabulary) for _ in range(pick.randint(0, 40))]
        if i % 2:
            k = pick.randrange(len(items))
            part = list(items[k])
            for _ in range(pick.randint(0, decontamination.allowed(len(part)) + 1)):
                part[pick.randrange(len(part))] = pick.choice(vocabulary)
            at = pick.randrange(len(doc) + 1)
            doc[at:at] = part
        docs.append(doc)
    brute = {(i, k) for i, d in enumerate(docs) for k, x in enumerate(items) if nearest_passage(x, d) <= decontamination.allowed(len(x))}
    d = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, b).collect()} == brute and len(brute) > 10 and {len(items[k]) for _, k in brute} >= {1, 5, 6, 7}


def test_recall_at_the_allowed_edits(spark):
    """Passages with just the allowed edits, shifts included, of items of all sizes."""
    pick = random.Random(11)
    items, docs = [], []
    for n in (8, 9, 13, 14, 20, 27, 40, 59) * 12:
        item = [f"v{pick.randrange(5000)}" for _ in range(n)]
        part = list(item)
        for _ in range(decontamination.allowed(n)):
            at = pick.randrange(len(part))
            part[at : at + pick.randint(0, 1)] = [f"n{pick.randrange(5000)}"] * pick.randint(0, 1)
        items.append((len(items), " ".join(item)))
        docs.append((len(docs), " ".join([f"a{pick.randrange(5000)}" for _ in range(pick.randint(0, 30))] + part + [f"b{pick.randrange(5000)}" for _ in range(pick.randint(0, 30))])))
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.doc_id == r.item_id} == {i for i, _ in docs}


def test_a_passage_that_many_documents_hold(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(i, f"start{i} {item} end{i}") for i in range(600)] + [(1000 + i, f"other text number {i} of no benchmark at all") for i in range(100)]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, item), (3, "benchmark")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i in range(600) for k in (1, 2)} | {(1000 + i, 3) for i in range(100)}
    assert all((r.start, r.end, r.edits) == (1, 11, 0) for r in got if r.item_id < 3)


def test_recall_of_walk_keys():
    pick, found, tried = random.Random(3), 0, 300
    for _ in range(tried):
        item = [pick.getrandbits(60) for _ in range(40)]
        window = list(item)
        for _ in range(6):
            at = pick.randrange(len(window))
            window[at : at + pick.randint(0, 1)] = [pick.getrandbits(60)] * pick.randint(0, 1)
        a, b = (decontamination.walk_keys(np.array((x + [0] * 40)[:40], np.uint64), 40) for x in (item, window))
        found += any(p == q for p, q in zip(a, b))
    assert found / tried >= 0.95


# --- 3: WARC


RECORDS = "record_id long, type string, url string, d string, headers array<struct<name:string,value:string>>, payload_sha256 string, payload_chars long"


def headers(**v):
    return [(k.replace("_", "-"), x) for k, x in sorted(v.items())]


def test_canonical_urls(spark):
    want = {"/p?xutm_id=1&b=2": "/p?xutm_id=1&b=2", "/p?xutm_id=9&b=2": "/p?xutm_id=9&b=2", "/utm_a=1/x?b=2": "/utm_a=1/x?b=2", "HTTP://www.A.b:80//?utm_x&&u=/&": "a.b?u=/", "https://a.b:443/c//?x=1/#f": "a.b/c?x=1/", "a.b:8080/?": "a.b:8080", "": ""}
    df = spark.createDataFrame([*want.items()], "url string, want string")
    assert {r.url: r.got for r in df.select("url", warc.canonical_url(F.col("url")).alias("got")).collect()} == want


def test_only_full_responses_and_weak_tags(spark):
    rows = [(1, "response", "a.b/x", "2024-01-01 00:00:00", headers(etag='W/"1"'), "p1", 5, 200), (2, "response", "a.b/x", "2024-01-02 00:00:00", headers(etag='"2"'), "p2", 1, 206), (3, "response", "a.b/x", "2024-01-03 00:00:00", headers(etag='"3"'), "p3", 1, 404), (4, "response", "a.b/x", "2024-01-04 00:00:00", headers(etag='"4"'), "p4", 1, None), (5, "revisit", "a.b/x", "2024-01-05 00:00:00", headers(etag='"1"'), None, None, 304)]
    df = spark.createDataFrame(rows, RECORDS + ", http_status int").withColumn("date", F.to_timestamp("d"))
    got = warc.resolve_revisits(df).collect()
    assert [(r.record_id, r.status, r.base_id, r.payload_sha256) for r in got] == [(5, "resolved", 1, "p1")]


def test_slices_do_not_change_the_join(spark, monkeypatch):
    """A hot URL, outlying dates and ties, against a search of every revisit among all responses."""
    pick, rows = random.Random(12), []
    for i in range(900):
        url = "hot.com/x" if i % 3 else pick.choice(["a.b/", "c.d/q", None])
        day = pick.choice([None, *range(1, 9)]) if i != 7 else 27
        rows.append((i, pick.choice(["response", "revisit"]), url, day and f"{'1975' if i == 7 else '2024'}-01-{day:02d} 00:00:00", headers(etag=str(pick.randrange(3))), f"p{i}", i))
    monkeypatch.setattr(warc, "SLICE", 50)
    df = spark.createDataFrame(rows, RECORDS).withColumns({"date": F.to_timestamp("d"), "http_status": F.lit(200)})
    got = {r.record_id: (r.status, r.base_id) for r in warc.resolve_revisits(df).collect()}
    want = {}
    for r in (r for r in rows if r[1] == "revisit"):
        base = max(((b[3], b[0], b[4]) for b in rows if b[1] == "response" and b[3] and r[3] and (b[2] or "").rstrip("/") == (r[2] or "").rstrip("/") and (b[2] is None) == (r[2] is None) and b[3] < r[3]), default=None)
        want[r[0]] = ("orphan", None) if base is None else ("resolved", base[1]) if base[2] == r[4] else ("mismatch", None)
    assert got == want


def test_revisits(spark):
    rows = [(1, "response", "http://a.com/x/", "2024-01-01 00:00:00", headers(etag="1", content_type="t", content_length="5", server="s"), "p1", 5), (2, "response", "https://www.A.com/x#f", "2024-01-02 00:00:00", headers(etag="2", content_type="t"), "p2", 6), (3, "revisit", "http://a.com:80/x?utm_s=1", "2024-01-01 12:00:00", headers(etag="1", content_length="0", expires="e"), None, None), (4, "revisit", "http://a.com/x", "2024-01-03 00:00:00", headers(etag="1"), None, None), (5, "revisit", "http://a.com/x", "2024-01-01 00:00:00", headers(etag="1"), None, None), (6, "revisit", "http://b.com/", "2024-01-03 00:00:00", None, None, None), (7, "revisit", "http://a.com/x", None, headers(etag="1"), None, None), (8, "revisit", "http://a.com/x", "2024-02-03 00:00:00", headers(), None, None)]
    df = spark.createDataFrame(rows, RECORDS).withColumns({"date": F.to_timestamp("d"), "http_status": F.lit(200)})
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: r.status for k, r in got.items()} == {3: "resolved", 4: "mismatch", 5: "orphan", 6: "orphan", 7: "orphan", 8: "mismatch"}
    assert got[3].base_id == 1 and got[3].payload_sha256 == "p1"
    assert [tuple(h) for h in got[3].headers] == headers(etag="1", content_type="t", content_length="5", server="s", expires="e")


# --- 4: chat


def test_chat_round_trip(spark):
    pick = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>\n", "<\\|", "<\\\\|im_end|>", "\\", "\n", "a", "assistant", "<", "|", "\x00", "é"]
    rows = [(c, t, pick.choice(["user", "assistant", "a\nb", "\\n", "\\\\n\n", "<|x"]), "".join(pick.choices(parts, k=pick.randint(0, 8)))) for c in range(60) for t in range(pick.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    texts = {r.conv_id: (r.formatted, r["mask"]) for r in made.collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in sorted(r for r in rows if r[0] == c)]
        said, learnt = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        text, mask = texts[c]
        assert text.count("<|im_start|>") == len(turns) == got[c].n_turns and sum(m.chars for m in mask) == len(text) == got[c].formatted_chars
        at, masked = 0, ""
        for m in mask:
            masked, at = masked + text[at : at + m.chars] * m.learnt, at + m.chars
        assert re.sub(r"<\\(\\*)\|", r"<\1|", masked) == learnt


# --- 5: secrets


def test_spans_against_plain_regular_expressions(spark):
    pick = random.Random(9)
    parts = ["password", "Token", "api_key", "=", ":", ' = "', "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef" * 3, "x" * 12, "é", " ", "\n", "secret:", "a1b2c3d4e5f6g7h8i9j0k1"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 14))) for _ in range(300)]
    kinds = {"assign": (re.compile(secrets.PATTERNS["assign"]), 2, 12), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}
    df = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secrets.scan_secrets(df, keep=("doc_id",)).collect():
        want = sorted((m.start(), list(kinds).index(k), m.end(), k) for k, (p, g, least) in kinds.items() for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= least)
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want), texts[r.doc_id]
        assert set(r.base_spans.split(",")) <= set(r.spans.split(",")) or not want
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert len(clean) == len(texts) and not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) for t in clean.values())


def test_owned_and_copied(spark):
    key, shared = "Zx9Kq2Lw8Rt5Yp3Mn7Bv", "Aa1Bb2Cc3Dd4Ee5Ff6Gg"
    df = spark.createDataFrame([(i, f"see {shared} here", f"s{i}") for i in range(5)] + [(9, f"my {key} and {shared}", "s9")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df, keep=("doc_id",)).collect()}
    assert got[9].spans == "owned:3:23" and got[9].n_owned == 1 and got[9].n_copied == 1 and got[0].spans == ""


def test_many_repositories_of_one_owner_hold_copies(spark):
    key, shared, few = "Zx9Kq2Lw8Rt5Yp3Mn7Bv", "Aa1Bb2Cc3Dd4Ee5Ff6Gg", "Hh1Jj2Kk3Ll4Mm5Nn6Pp"
    rows = [(i, f"see {shared} here", "hot") for i in range(2000)] + [(5000, f"my {key} and {shared}", "hot")]
    rows += [(6000 + i, f"run {i} with {few}", "hot") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df, keep=("doc_id",)).collect()}
    assert all(got[i].spans == "" and (got[i].n_owned, got[i].n_copied) == (0, 1) for i in range(2000))
    assert got[5000].spans == "owned:3:23" and (got[5000].n_owned, got[5000].n_copied) == (1, 1)
    assert (got[5000].most_owners, got[5000].most_repos) == (1, 2001)
    assert {h.hash: (h.owners, h.repos) for h in got[5000].held} == {hashlib.sha256(v.encode()).hexdigest(): n for v, n in ((key, (1, 1)), (shared, (1, 2001)))}
    assert all(got[6000 + i].n_owned == 1 for i in range(10))
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] == f"see {shared} here" and clean[5000] == f"my {secrets.MASK} and {shared}"


def test_fifty_documents_of_one_source_are_copies(spark):
    df = spark.createDataFrame([(i, "key Zx9Kq2Lw8Rt5Yp3Mn7Bv", "one") for i in range(50)], "doc_id long, text string, source string")
    assert {(r.spans, r.n_owned, r.n_copied, r.most_owners, r.most_repos) for r in secrets.scan_secrets(df).collect()} == {("", 0, 1, 1, 50)}


def test_values_that_do_not_look_live_are_not_owned(spark):
    df = spark.createDataFrame([(1, "password = aaaaaaaaaaaa1, token: hV7xQ2mN9pL4", "a")], "doc_id long, text string, source string")
    r = secrets.scan_secrets(df).first()
    assert (r.n_assign, r.n_owned, r.n_copied, r.spans) == (2, 1, 0, "assign:0:24,assign:26:45")


def test_owned_spans_equal_the_sql(spark, tmp_path):
    """Values of one to four sources and one to thirty documents, in all kinds."""
    pick = random.Random(13)
    values = ["".join(pick.choices("abcdefABCDEF0123456789xyz", k=24)) for _ in range(25)] + ["AKIA" + "".join(pick.choices("ABCDEFGH0123456789", k=16)) for _ in range(5)] + ["0123456789abcdef" * k for k in (1, 2)]
    rows = [(i, " ".join(pick.choice(["", "token=", "x "]) + v for v in pick.sample(values[: 1 + i % len(values)], min(1 + i % 3, 1 + i % len(values)))), f"s{pick.randrange(1 + i % 4)}") for i in range(300)]
    spark.createDataFrame(rows + [(999, None, None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(secrets.ORACLES["op5_secrets"]).df().sort_values("doc_id").to_dict("records")
    got = secrets.op5_secrets(spark, str(tmp_path)).toPandas().sort_values("doc_id").to_dict("records")
    assert got == [{k: w[k] for k in got[0]} for w in want] and any("owned" in r["spans"] for r in got) and any(r["n_copied"] for r in got)


def test_very_many_matches_and_hot_hashes(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HOT", 20)
    text = " ".join(f"{i:016x}" for i in range(20_000))
    df = spark.createDataFrame([(1, text, "a")] + [(i, "see Aa1Bb2Cc3Dd4Ee5Ff6Gg", "b") for i in range(2, 60)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df, keep=("doc_id",)).collect()}
    assert got[1].n_hex == 20_000 and got[1].base_spans == ",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(20_000))
    assert all((got[i].n_copied, got[i].most_repos) == (1, 58) for i in range(2, 60))


# --- 6: rules


def test_base_counts():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)

    pick = random.Random(2)
    for _ in range(400):
        text = "".join(pick.choices(["a", "b", " ", " ", "\n", "#", "\x0b", " ", "\xa0", "é"], k=pick.randint(0, 80)))
        assert quality_rules.base_counts(text) == brute(text)


def test_rules_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in quality_rules.op6_quality_rules(spark, DATA).collect()}
    bands = quartile_bands(spark)
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        r, by = rows[d.doc_id], dict(zip(quality_rules.VOCABULARIES, plain_measures(d.text))) if d.text else {}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_rules.base_counts(d.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and not r.outside)
        for v, (_, *measures) in by.items():
            assert [r[f"{v}_{m}"] for m in ("chars_per_token", "byte_share", "entropy")] == pytest.approx(measures)
        if not r.base_failed:
            beyond = []
            for m, floor in quality_rules.FLOOR.items():
                out = []
                for v in quality_rules.VOCABULARIES:
                    low, mid, high = bands[d.lang, quality_rules.script(d.text), int(np.log2(by["piece"][0]))][f"{v}_{m}"]
                    out.append(not mid - max(5 * (mid - low), floor) <= r[f"{v}_{m}"] <= mid + max(5 * (high - mid), floor))
                beyond += [m] * all(out)
            assert r.outside == beyond


_plain = {}


def plain_measures(text):
    """By each library itself: token count, characters per token, share of tokens that are no whole characters, relative entropy."""
    if not _plain:
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines()
        ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in lines}
        coding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _plain.update(piece=(model.encode, model.is_byte), multi=(coding.encode_ordinary, lambda i: b"\xef\xbf\xbd" in coding.decode_single_token_bytes(i).decode("utf-8", "replace").encode()))
    out = []
    for encode, is_part in (_plain["piece"], _plain["multi"]):
        ids = encode(text)
        shares = [ids.count(i) / len(ids) for i in set(ids)]
        out.append((len(ids), len(text) / len(ids), sum(map(is_part, ids)) / len(ids), -sum(x * math.log2(x) for x in shares) / math.log2(len(ids)) if len(ids) > 1 else 1.0))
    return out


def test_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    by = [{r.doc_id: (r.kept, r.outside) for r in quality_rules.judge(docs.repartition(n)).select("doc_id", "kept", "outside").collect()} for n in (1, 13)]
    assert by[0] == by[1] and len(by[0]) == 1000


def quartile_bands(spark):
    """Bands from exact quartiles (between two ranks in proportion) of measures in steps of 0.001, by plain loops."""
    docs = [(r.lang, quality_rules.script(r.text), r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = {}
    for lang, script, text in docs:
        n, *_, repeats = quality_rules.base_counts(text)
        if n >= 10 and 100 * repeats <= 20 * n:
            by = plain_measures(text)
            rows[lang, script, int(np.log2(by[0][0])), text] = [x for m in by for x in m[1:]]

    def quartiles(keys):
        values = {k[3]: rows[k] for k in keys}.values()
        return {m: np.percentile([np.floor(min(v[i], 1000) * 1000 + 0.5) / 1000 for v in values], (25, 50, 75)) for i, m in enumerate(quality_rules.MEASURES)}, len(values)

    out = {}
    for lang, script, size in {k[:3] for k in rows}:
        band, _ = quartiles([k for k in rows if k[2] == size])
        for keys in ([k for k in rows if k[1:3] == (script, size)], [k for k in rows if k[:3] == (lang, script, size)]):
            own, n = quartiles(keys)
            w = n / (n + quality_rules.LEAN)
            band = {m: w * own[m] + (1 - w) * band[m] for m in own}
        out[lang, script, size] = band
    return out


def test_verdicts_move_steadily(spark):
    """A text of a language of few texts is judged by its script as well, and a language of its own text does not judge itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 700 AND 1400").select("doc_id", "lang", "text")
    pick = random.Random(3)
    junk = " ".join("".join(pick.choices("qxzjkvw", k=pick.randint(4, 9))) for _ in range(90))
    more = spark.createDataFrame([(-1, "xx", junk)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs.union(more)).collect()}
    assert "chars_per_token" in got[-1].outside and not got[-1].kept
    good = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect() if r.doc_id in got]
    assert sum(got[i].kept for i in good) > 0.9 * len(good) > 20


def test_copies_do_not_narrow_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    before = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    # the clean text of the longest bucket, so that its copies fill it, held by a third of all rows
    copied = max((r for r in before.values() if r.kept and r.lang == "es"), key=lambda r: (r.n_tokens, r.doc_id))
    copies = spark.range(len(before) // 2).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit(copied.lang).alias("lang"), F.lit(copied.text).alias("text"))
    after = {r.doc_id: r for r in quality_rules.judge(docs.union(copies)).collect()}
    assert len(after) == len(before) + len(before) // 2 and all(r.kept for i, r in after.items() if i >= 1_000_000)
    assert {i: (after[i].outside, after[i].kept) for i in before} == {i: (r.outside, r.kept) for i, r in before.items()}


# --- 7: BPE


def odd_texts(n, seed):
    pick = random.Random(seed)
    pool = ["aaaa", "!!!!!!", "----====", "<|endoftext|>", "<s>", "<0x41>", " \t\n", "\x1c\x1d\x85", "​　", "é😀", "中文字", "0123456789", "ing", "tion", "\x00ÿ", "▁", "'s", " ", "ab", "\n"]
    return ["".join(pick.choice(pool) * pick.choice([1, 1, 2, 3, 40]) for _ in range(pick.randint(0, 10))) for _ in range(n)] + [x * 2500 for x in ("a", "-=", "= ", "é", " ")]


def test_transducer_equals_the_library(spark):
    own, path = bpe.codec(public_tokenizers.path(bpe.VOCAB)), public_tokenizers.path(bpe.VOCAB)
    library = tokenizers.Tokenizer.from_file(path)
    for text in odd_texts(600, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and bpe.decoded(ids, bpe.token_bytes(path)) == library.decode(ids, skip_special_tokens=False) == text
    pick = random.Random(4)
    for _ in range(200):
        ids = [pick.randrange(50257) for _ in range(30)]
        assert bpe.decoded(ids, bpe.token_bytes(path)) == library.decode(ids, skip_special_tokens=False)


def test_stream_keeps_a_bounded_buffer():
    own = bpe.codec(public_tokenizers.path(bpe.VOCAB))
    encoder, most, out = bpe.Encoder(own.merges), 0, []
    for _ in range(200):
        out += encoder.feed("-=-==ab" * 20)
        most = max(most, len(encoder.text))
    assert most <= own.merges.lookahead + own.merges.longest + 140 and len(out) > 1000
    for unit in ("a", "-=", " ", "word and ", "é", "1"):
        stream, most = bpe.Stream(own), 0
        for _ in range(300):
            stream.feed(unit * 100)
            most = max(most, len(stream.held) + (len(stream.open[0].text) if stream.open else 0))
        assert most <= own.margin + bpe.CHUNK + own.merges.lookahead + own.merges.longest + 400, unit


@pytest.mark.parametrize("portion", [5, 64, 1000])
def test_portions_do_not_change_tokens(monkeypatch, portion):
    monkeypatch.setattr(bpe, "PORTION", portion)
    own, library = bpe.codec(public_tokenizers.path(bpe.VOCAB)), tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))
    for text in odd_texts(300, portion):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_token_comes_out_of_an_encoder(spark, monkeypatch):
    own, emitted = bpe.Codec(public_tokenizers.path(bpe.VOCAB)), []
    emit = bpe.Encoder._emit

    def watched(self, ended):
        out = emit(self, ended)
        emitted.append((len(out), ended))
        return out

    monkeypatch.setattr(bpe.Encoder, "_emit", watched)
    own.pieces.most = own.pieces.longest = 0  # nothing is remembered
    for d in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect():
        emitted.clear()
        assert len(own.encode(d.text)) == sum(n for n, _ in emitted)
    assert any(n for n, ended in emitted if not ended)


def test_lookahead_of_a_token_is_sufficient():
    """What an encoder has emitted is what the whole text has, for any way to cut it."""
    own, pick = bpe.codec(public_tokenizers.path(bpe.VOCAB)), random.Random(14)
    for _ in range(300):
        text = "".join(pick.choice(["-", "=", "a", "in", "th", "ing", "--", "ation", "\u00e9", "."]) for _ in range(pick.randint(1, 80))).encode().decode("latin-1")
        encoder, out = bpe.Encoder(own.merges), []
        while text[sum(map(len, out)) :] and len(out) < 200:
            cut = pick.randint(1, 6)
            rest = text[sum(map(len, out)) :]
            out.append(rest[:cut])
        tokens = [t for part in out for t in encoder.feed(part)] + encoder.finish()
        whole = bpe.Encoder(own.merges)
        whole.feed(text)
        again = bpe.Encoder(own.merges)
        assert tokens == again.feed(text) + again.finish()


def test_bpe_query_against_the_library(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))
    rows = {r.doc_id: r for r in bpe.op7_bpe(spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids) and rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


# --- 8: near-duplicates


def test_sketch_agreement_follows_similarity():
    random_ = np.random.default_rng(1)
    for n, shared in ((3, 1), (40, 30), (500, 400)):
        agree = []
        for _ in range(60):
            x = np.unique(random_.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64))
            a, b = sketch.sketch(np.sort(x[:n])), sketch.sketch(np.sort(x[n - shared :]))
            assert (a >> np.uint64(54) < 2 * sketch.SIZE).all()
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.04


def brute_components(docs, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    pick = random.Random(6)
    base = [[pick.choice("abcdefghij") + str(pick.randint(0, 99)) for _ in range(pick.choice([3, 6, 60, 200]))] for _ in range(25)]
    docs = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B")]
    for i in range(260):
        words = list(pick.choice(base) if i % 2 else base[0])
        for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
            words[pick.randrange(len(words))] = pick.choice("xyz") + str(pick.randint(0, 3))
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(docs)


def test_stage_links_from_80_percent(spark):
    docs = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(104)]
        # 90 shingles each; pairs 0 to 19 share 80 of 100, pairs 20 to 39 share 79 of 101
        shift = 10 if i < 20 else 11
        docs += [(2 * i, " ".join(words[:94])), (2 * i + 1, " ".join((words + ["end"])[shift : shift + 94]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()}
    assert left == {i for i, _ in docs} - {2 * i + 1 for i in range(20)}
    assert all(r.kept for r in near_dup.near_duplicates(df).collect())
    assert sketch.banding(85) == (sketch.BANDS, sketch.ROWS) and sketch.banding(80) == (28, 5)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(129, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in [*range(100, 130), 200]) and got[301] == 300


def test_block_search_equals_join_search(spark, monkeypatch):
    pick = random.Random(8)
    base = [str(pick.randint(0, 9)) + pick.choice("abc") for _ in range(150)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(pick.randint(0, 9)):
            words[pick.randrange(150)] = f"n{pick.randint(0, 20)}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(docs)


def test_texts_just_below_the_threshold(spark):
    """Many documents that share four fifths of their words with all others: no pair is linked but the planted ones."""
    common = " ".join(f"c{i}" for i in range(150))
    docs = [(i, common + " " + " ".join(f"own{i}x{k}" for k in range(16))) for i in range(3000)]
    docs += [(10_000 + i, docs[i][1] + " end") for i in range(0, 3000, 300)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 10_000 for i, _ in docs}


def test_without(spark):
    rows = spark.createDataFrame([(i,) for i in range(1000)] + [(None,)], "k long")
    rows = rows.withColumns({c: F.lit(c) for c in ("__at", "__row", "__maybe", "__words", "doc", "key", "maybe", "gone", "line", "words", "a.b")})
    left = without(rows, "k", spark.createDataFrame([(i,) for i in range(0, 1000, 3)], "d long"))
    assert left.columns == rows.columns and all(r[c] == c for r in left.collect() for c in rows.columns[1:])
    assert {r.k for r in left.collect()} == {i for i in range(1000) if i % 3} | {None}


# --- 10: token counts


def test_prefix_counts_equal_the_library(spark):
    own = token_counts.counter(public_tokenizers.path(token_counts.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    texts, want = [], {}
    for k, text in enumerate(odd_texts(500, 2)):
        assert own.all_prefixes(text)[-1] == len(library.encode(text)), text[:80]
        if k % 25 == 0 and len(text) < 600:
            texts.append((k, text))
            want[k] = [len(library.encode(text[:n])) for n in range(len(text) + 1)]
    got = token_counts.prefix_counts(spark.createDataFrame(texts, "k int, text string"))
    budgets = (0, 1, 3, 10, 60)
    for r in got.select("k", "prefix_tokens", *[token_counts.chars_within(F.col("prefix_tokens"), b).alias(f"b{b}") for b in budgets], token_counts.tokens_at(F.col("prefix_tokens"), 1).alias("one")).collect():
        assert r.prefix_tokens == want[r.k] and all(r[f"b{b}"] == max(n for n, c in enumerate(want[r.k]) if c <= b) for b in budgets)
        assert r.one == (want[r.k][1] if len(want[r.k]) > 1 else None)


def test_counts_query_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rows = {r.doc_id: r for r in token_counts.op10_token_counts(spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        n, r = len(library.encode(d.text)), rows[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 4096) and (r.chars_in_limit == len(d.text)) == (n <= 4096)
    assert token_counts.prefix_counts(odd_documents(spark).where("doc_id = 2")).first().prefix_tokens == [0]
