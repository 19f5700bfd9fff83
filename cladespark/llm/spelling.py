"""Spelling variants of the corpus's words: permuterm rotations, sorted and scanned.

Every word is marked with an end sign and rotated. A word with its k-th letter left out is, in the rotation that starts after that
letter, all but the last place: what stands behind the letter, the end sign, what stands before it. So of two words of which
one has another letter in one place, both have the same such beginning, and a word that lacks the letter has it as a
whole rotation. In the sorted rotations these are a prefix range: the whole rotation first, if it is a word's, then those that
go on with one more letter. One scan of the range gives each of its members how many near words it has there and the most frequent of
them (the best of all, for the best the second), so that no pair is made; a range holds one row for each letter of
the alphabet at most, and one more. A letter that is dropped from a stretch of equal ones is dropped at its first place only, so
that two words meet once.

Words, their counts and all that follows are columns of Spark; nothing is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm.common import discard, materialized, table

#: Code points of a word, occurrences of a word, and how many times as frequent a word's form is, at least.
SHORTEST, RAREST, TIMES = 6, 5, 5
#: One run in so many loses a letter in op11, by its checksum.
SLIPS = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands behind a word; sorts below all letters.
END = "$"


def runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id and, for each maximal run of letters of at least `shortest` code points, run (A-Z lower-cased)."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))).alias("run"))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run without one letter where op11's contract takes one out. A null doc_id counts as the empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """words: word. word, n of the words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def rotations(words: DataFrame) -> DataFrame:
    """words: word, n. Each rotation as the range (key) it stands in: all but its last place with letter, the last place, and
    once more whole, with an empty letter. first: the letter is the first of a stretch of equal ones."""
    k = F.col("k")
    before, after = F.substring("word", F.lit(1), k), F.substring(F.col("word"), k + 1, F.length("word"))
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("k"))
    whole = placed.select("word", "n", F.concat(after, F.lit(END), before).alias("key"), F.lit("").alias("letter"), F.lit(False).alias("first"))
    letter = F.substring(F.col("word"), k + 1, F.lit(1))
    earlier = F.substring(F.col("word"), F.greatest(k, F.lit(1)), F.lit(1))
    less = placed.where(k < F.length("word")).select("word", "n", F.concat(F.substring(F.col("word"), k + 2, F.length("word")), F.lit(END), before).alias("key"), letter.alias("letter"), ((k == 0) | (letter != earlier)).alias("first"))
    return whole.unionByName(less)


def near_words(words: DataFrame) -> DataFrame:
    """words: word (once each), n. word, n, n_near (how many words differ from it by one letter more, less or other) and best (least,
    word: minus the count, and the word, of the most frequent of them, the first in code-point order of equal ones; null if none)."""
    group = Window.partitionBy("key")
    scan = Window.partitionBy("key").orderBy("letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, skips = F.struct((-F.col("n")).alias("least"), "word"), F.col("letter") != ""
    ranges = rotations(words).withColumns({
        "others": F.count(F.when(skips, 1)).over(scan), "top": F.min(F.when(skips, own)).over(scan), "firsts": F.count(F.when(F.col("first"), 1)).over(scan),
        "top_first": F.min(F.when(F.col("first"), own)).over(scan), "lacking": F.min(F.when(~skips, own)).over(scan),
    })
    ranges = ranges.withColumn("second", F.min(F.when(skips & (F.col("word") != F.col("top.word")), own)).over(group))
    other = F.when(F.col("word") == F.col("top.word"), F.col("second")).otherwise(F.col("top"))
    lacks = F.when(F.col("first"), F.col("lacking"))
    found = ranges.select(
        "word", F.when(skips, F.col("others") - 1 + lacks.isNotNull().cast("long")).otherwise(F.col("firsts")).alias("near"),
        F.when(skips, F.least(other, lacks)).otherwise(F.col("top_first")).alias("best"),
    ).where("near > 0")
    best = found.groupBy(F.col("word").alias("__word")).agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    got = words.join(best, F.col("word") == F.col("__word"), "left")
    return got.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (not null). word, root: the last form that the forms lead to. Each form is several times as frequent as its
    word, so chains are short; what each word looks at is doubled in every round."""
    chains = materialized(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = chains.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        got = chains.join(further, F.col("root") == F.col("__at"), "left")
        longer = materialized(got.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "forms")
        discard(chains)
        if not longer.where("moved").head(1):
            return longer.select("word", "root")
        chains = longer


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words: word (once each, without END), n. word, form, root, n, n_near, form_n.

    form: the most frequent near word (ties: the first in code-point order), if it is `times` as frequent as the word or more,
    else null; root: where the forms lead, the word itself without any.

    Cases: a null word is left out; the empty word is near all words of one letter; words of any length; ties as said; an empty table
    gives an empty one; other columns are not used."""
    words = materialized(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words)
    fits = -F.col("best.least") >= times * F.col("n")
    got = materialized(near.select("word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.least")).alias("form_n")), "near-words")
    chains = roots(got.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "__word")
    return got.join(chains, F.col("word") == F.col("__word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: null and empty texts have no words; texts of any length are taken whole; repeated rows count again; other columns of the
    table are not used."""
    found = runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return variants(counted(found.select(slipped(F.col("doc_id"), F.col("run")).alias("word"))))


#: Near words as pairs: of equal length with the same rest around one place, or one of them with a letter left out.
ORACLE = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {SHORTEST}),
bytes AS (SELECT s, run, count(*) AS times, flatten(list_transform(range(1, length(s) + 1), lambda k: CASE WHEN unicode(s[k]) < 128 THEN [unicode(s[k]), -1, -1, -1, -1, -1, -1, -1, -1]
  ELSE [192 + (unicode(s[k]) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(s[k]) & 63), -1, -1, -1, -1, -1, -1, -1, -1] END)) AS b FROM runs GROUP BY s, run),
sums AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS h FROM bytes),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {RAREST}),
less AS (SELECT word, k, substr(word, 1, k) AS a, substr(word, k + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT x.word AS v, y.word AS w FROM less x JOIN less y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word FROM less x JOIN words y ON x.a || x.b = y.word UNION SELECT y.word, x.word FROM less x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT v, count(*) OVER (PARTITION BY v) AS n_near, w, n AS m FROM pairs JOIN words ON word = w QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC, w) = 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN w END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM words LEFT JOIN best ON v = word),
steps AS (SELECT word, form AS at_ FROM forms WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at_ WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.at_ AS root FROM steps s JOIN forms f ON f.word = s.at_ WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON e.word = f.word"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": ORACLE}
