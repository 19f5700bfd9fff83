"""Quality rules with tokeniser fertility.

Two public vocabularies, one of pieces with byte fallback and one of bytes for many languages, measure each text:
characters per token, share of byte-fallback tokens (tokens that are no whole characters), and the entropy of its tokens
relative to the most that so many tokens could have. Per language and power of two of the token count the corpus gives
the middle and the quartiles of each measure over all distinct texts, so that copies of one text do not narrow the band of
others. A document whose measure lies far outside the band of its own kind by both vocabularies is rejected, as are
those that the base rules reject.

Bands of few texts lean on wider ones: the quartiles of a language count with n / (n + LEAN), the rest is the band of the
script, which leans in the same way on that of all texts of the length. So the verdict on a text moves steadily as its
language grows, and a script of few texts does not judge itself.

Cases: null or empty text has no words and fails the base rules; texts of any length are read whole; a null language is
a group of its own; repeated rows and ties are each judged alike; an empty table gives an empty one; other columns
are kept, whatever their names, and one with an output's name is replaced.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import WORD, held, materialized, table, whole, with_made

#: The vocabularies: name in column names -> file of public_tokenizers, or a path that each executor has.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "multi": "byte_bpe_multi_50k.tiktoken"}
#: A band reaches so many quartile distances from the middle, to either side.
WIDTH = 5.0
#: Distinct texts at which a band counts for half, and the wider one for the other half.
LEAN = 50
#: Bands (of less than 500 bytes each) are broadcast up to this many.
MOST_BANDS = 50_000
#: Measures above it count as this in a band.
HIGHEST = 1000.0
#: No band is narrower than this on either side.
FLOOR = {"chars_per_token": 0.1, "byte_share": 0.02, "entropy": 0.03}
MEASURES = [f"{v}_{m}" for v in VOCABULARIES for m in FLOOR]
_word = re.compile(WORD)
_symbol = re.compile(r"[#*$%&|<>]")

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Columns that name a text.
TEXT = ("text1", "text2")
SCHEMA = f"{BASE}, script string, n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = _word.findall(text)
    lines = [x for x in text.split("\n") if _word.search(x)]
    repeats = 0
    if len(words) >= 5:
        windows = [*zip(words, words[1:], words[2:], words[3:], words[4:])]
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeats += k + 5 - max(k, covered)
                    covered = k + 5
    return len(words), sum(map(len, words)), len(_symbol.findall(text)), len(lines) - len(set(lines)), repeats


@lru_cache(100_000)
def letter_script(letter: str) -> str:
    return unicodedata.name(letter, "UNKNOWN").split(" ")[0]


def script(text: str) -> str:
    """The script of most letters."""
    found: Counter[str] = Counter()
    for letter in set(text):
        if letter.isalpha():
            found[letter_script(letter)] += text.count(letter)
    return min(found.items(), key=lambda x: (-x[1], x[0]))[0] if found else "NONE"


class Fertility:
    """A vocabulary: texts -> token count, characters per token, share of tokens that are no whole characters, relative entropy."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.fallback = {i for i in range(model.get_piece_size()) if model.is_byte(i)}
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: map(coding.encode_ordinary, texts)
            self.fallback = {i for t, i in ranks.items() if "\ufffd" in t.decode("utf-8", "replace")}

    def measure(self, texts: list[str]) -> list[tuple[int, float, float, float]]:
        out = []
        for text, ids in zip(texts, self.encode(texts)):
            if not ids:
                out.append((0, 0.0, 0.0, 0.0))
                continue
            n, times = len(ids), Counter(ids)
            p = np.fromiter(times.values(), float, len(times)) / n
            fallback = sum(times[i] for i in times.keys() & self.fallback)
            out.append((n, len(text) / n, fallback / n, float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 1.0))
        return out


def fertility(path: str) -> Fertility:
    return held(("fertility", path), lambda: Fertility(path))


def measured(docs: DataFrame, text: str = "text", vocabularies: dict[str, str] = VOCABULARIES) -> DataFrame:
    """docs with the base counts, script, n_tokens of the first vocabulary and the measures of the whole text by each."""

    def maker():
        own = [fertility(v if "/" in v else public_tokenizers.path(v)) for v in vocabularies.values()]

        def measures(texts: list) -> list:
            texts = [t or "" for t in texts]
            by = [o.measure(texts) for o in own]
            return [*zip(*[(*base_counts(t), script(t), m[0][0], *(x for v in m for x in v[1:])) for t, *m in zip(texts, *by)])]

        return measures

    return with_made(docs, text, SCHEMA, maker)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def bands(texts: DataFrame, *keys: str) -> DataFrame:
    """Per key: how many texts, and for each measure the lower quartile, middle and upper quartile over all of them. The measures are taken
    in steps of 0.001, of which each is counted, so the quartiles are those of the table however it is partitioned."""
    steps = [F.percentile(F.round(F.least(m, F.lit(HIGHEST)), 3), F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias(m) for m in MEASURES]
    return texts.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(*steps).alias("band"))


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has been counted to be small; documents are then judged without a shuffle."""
    return F.broadcast(table) if table.count() <= MOST_BANDS else table


def leaning(n: Column, own: Column, wider: Column, lean: float) -> Column:
    """Quartiles of a band of n texts, mixed with those of the wider band."""
    w = n / (n + lean)
    return F.struct(*[F.zip_with(own[m], wider[m], lambda x, y: w * x + (1 - w) * y).alias(m) for m in MEASURES])


def verdicts(rows: DataFrame, width: float = WIDTH, lean: float = LEAN) -> DataFrame:
    """rows: doc (a struct), lang, TEXT (two hashes of the text) and the columns of SCHEMA. One row each: doc, those columns but lang
    and TEXT, base_failed, outside (the measures that lie outside their band by every vocabulary) and kept."""
    rows = rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = rows.withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))).cast("int"))
    # each text counts once in a band, however many rows hold it
    texts = rows.where(~F.col("base_failed")).groupBy("lang", "script", "size", *TEXT).agg(*[F.first(m).alias(m) for m in MEASURES])
    texts = materialized(texts, "texts")
    once = texts.dropDuplicates(["script", "size", *TEXT])
    all_ = materialized(bands(once, "size").select("size", F.col("band").alias("wide")), "size-bands")
    by_script = bands(once, "script", "size").join(all_, "size")
    by_script = materialized(by_script.select("script", "size", leaning(F.col("n"), F.col("band"), F.col("wide"), lean).alias("wide")), "script-bands")
    by_lang = bands(texts, "lang", "script", "size").join(by_script, ["script", "size"])
    by_lang = materialized(by_lang.select("lang", F.col("script").alias("s"), F.col("size").alias("z"), leaning(F.col("n"), F.col("band"), F.col("wide"), lean).alias("band")), "bands")
    got = rows.withColumnRenamed("lang", "l").join(small(by_lang), F.col("l").eqNullSafe(F.col("lang")) & (F.col("script") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    outside = []
    for m in FLOOR:
        beyond = F.lit(True)
        for v in VOCABULARIES:
            x, (low, mid, high) = F.col(f"{v}_{m}"), (F.col("band")[f"{v}_{m}"][k] for k in range(3))
            down, up = (F.greatest(width * y, F.lit(FLOOR[m])) for y in (mid - low, high - mid))
            beyond = beyond & ((x < mid - down) | (x > mid + up))
        outside.append(F.when(beyond, F.lit(m)))
    got = got.withColumn("outside", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*outside))))
    got = got.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
    return got.drop("l", "lang", "s", "z", "size", "band", *TEXT)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", vocabularies: dict[str, str] = VOCABULARIES, columns: list[str] | None = None) -> DataFrame:
    """docs (or these columns of it) with the base counts, fertility measures, base_failed, outside and kept; measured once, in the
    shared folder. text and lang: columns, or fields of a struct column."""
    kept = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    packed = text.split(".")[0] in kept.columns  # then the text is sent to Python in its row only
    rows = docs.select(whole(kept).alias("doc"), F.col(lang).alias("lang"), F.xxhash64(text).alias(TEXT[0]), F.xxhash64(F.lit(1), text).alias(TEXT[1]), *([] if packed else [F.col(text).alias("body")]))
    got = verdicts(materialized(measured(rows, f"doc.{text}" if packed else "body", vocabularies).drop("body"), "fertility"))
    new = [c for c in got.columns if c != "doc"]
    return got.select(*[F.col("doc")[c].alias(c) for c in kept.columns if c not in new], *new)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), columns=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES, "outside"
    )


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
