"""From raw documents to training tokens: rules, near-duplicates, decontamination, secrets, encoding.

Cases, in every stage: null and empty texts, texts of any length, repeated rows, rows without doc_id and empty tables are
allowed, and columns beside those of documents stay as they are, whatever their names (the last stage drops the text). A row is known by its doc_id or,
without one, by its text (`row_key`), so that verdicts on rows without doc_id take effect as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.bpe import encode_and_check
from cladespark.llm.common import materialized, table, whole, without
from cladespark.llm.decontamination import leaks
from cladespark.llm.near_dup import near_duplicates
from cladespark.llm.quality_rules import judge
from cladespark.llm.secrets import redact
from cladespark.sources.shared import discard, temporary


#: Rows, and bytes of their columns, that go to Python at once: an executor then holds few of the long texts. Spark's own limits are
#: 10,000 rows and 64 MB.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Inside, rows go to Python as FEW says, whatever the session says; its own settings, or none, hold again afterwards.
    What a stage sends to Python has to be written inside."""
    before = {name: spark.conf.get(name, None) for name in FEW}
    try:
        for name, value in FEW.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def row_key() -> Column:
    """doc_id; without one a number from 2^62 on that follows from the text, so that it is the representative of no row with a doc_id."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null and empty ones, those of the base rules, and those far outside the bands of their language.
    A null language is one of its own; repeated rows have one verdict."""
    with few_rows_at_once(spark):
        judged = judge(docs.select(whole(docs).alias("doc")), "doc.text", "doc.lang")
    return judged.where("kept").select("doc.*")


#: Percent of their shingles that two documents share at least to be near copies; op8 has its own.
NEAR = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked from NEAR percent up the document with the least doc_id stays, one without doc_id only where none of the
    group has one; of repeated rows (doc_id and text) the first by its columns written as JSON. Documents without words are in no group."""
    rows = docs.select(whole(docs).alias("doc"), row_key().alias("key"), "text")
    with few_rows_at_once(spark):
        gone = materialized(near_duplicates(rows, doc_id="key", percent=NEAR).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    kept = without(rows, "key", gone)
    again = rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("again"))
    again = materialized(again, "again")
    single = without(kept, "key", again)
    repeated = kept.join(again, F.col("key") == F.col("again"), "left_semi").groupBy("key", "text").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return single.select("doc.*").unionByName(repeated.select("doc.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty ones hold none."""
    rows = docs.select(whole(docs).alias("doc"), row_key().alias("key"), "text")
    with few_rows_at_once(spark):
        found = leaks(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
        found = materialized(found, "leaked")
    return without(rows, "key", found).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text (null where it is null)."""
    clean = redact(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in clean.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Instead of the text n_tokens, the token ids, and whether they decode to the text (a null one to nothing). Other columns stay;
    those of these three names are replaced. The result is written here, while few texts at once are on their way to Python."""
    others = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in others]).alias("doc"), "text")
    with few_rows_at_once(spark):
        made = materialized(encode_and_check(rows), "encoded")
    return made.select("doc.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [(f.__name__, f) for f in (quality_rules, near_dedup, decontamination, secret_scan, bpe)]
#: The vocabularies and the edit distance have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a stage, and its input, are deleted when its output is written; the last output stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, made in STAGES:
        with temporary(spark) as keep:
            docs = materialized(made(spark, docs, sf_dir), name)
            keep.append(docs.written_to)
        if before is not None:
            discard(before)
        before = docs
    return docs
