"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are read as words: A-Z lower-cased, ASCII punctuation and white space between words. An item of n words is
found in a document where a passage is within `allowed(n)` word edits of it (about 15 %).

1. A passage with at most k edits keeps a run of at least ceil((n - k) / (k + 1)) words of the item. Windows of n
   words are therefore laid only where such a run of an item occurs, at the place that lines the run up. That loses
   nothing and leaves most documents without a window. Items so short that no edit is allowed are their own run, and
   the first place in a text is enough.
2. Items and windows are embedded by REPEATS random walks each: step t writes the word at the pointer, and a random
   bit of (walk, t, word) moves the pointer on. Few edits leave most written words the same, so a key of SAMPLE
   sampled places agrees often. Items and windows with an equal key of any walk are candidates: an equi-join. Windows
   of the same words are one content and are joined once, however many documents hold them; the candidates of a content
   then go back to its windows by content and a salt of SALTS values, so that a passage in a third of all documents is
   spread over many tasks.
3. Candidates are verified by the edit distance of the item to the best passage in the window and `allowed(n)` words
   to either side.

The runs of the items are sent to executors in blocks of at most BLOCK_WORDS words, as sorted arrays and one pass over
the documents each, so what is sent is bounded however large the benchmark is.

Cases: null or empty texts hold nothing, and so do items without a word; texts of any length are read whole; repeated
items and documents give one row for each pair of ids; a null id is an id of its own; of passages that are equally near
the first counts; an empty table on either side gives an empty result; extra columns, whatever their names, are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import Remembered, materialized, table, with_made, word_hash_bytes
from cladespark.llm.sketch import mixed

EDITS = 0.15
LONGEST_RUN = 5
REPEATS, SAMPLE = 40, 3
BLOCK_WORDS = 2_000_000
SALTS = 16
SEED = np.uint64(0x2545F4914F6CDD1D)
_letters = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_letters).split()


def allowed(n: int) -> int:
    return int(EDITS * n)


def run_length(n: int) -> int:
    """Words in a row that any passage within the allowed edits keeps."""
    return min(LONGEST_RUN, math.ceil((n - allowed(n)) / (allowed(n) + 1)))


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of `length` words."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - length + 1, length, np.uint64)
    for k in range(length):
        out = mixed(out + h[k : len(h) - length + 1 + k])
    return out


def walk_keys(h: np.ndarray, n: int) -> list[int]:
    """A key for each walk over the words h of an item or window of n words."""
    places = np.sort(mixed(np.arange(REPEATS * SAMPLE, dtype=np.uint64) * SEED + np.uint64(n)).reshape(REPEATS, SAMPLE) % np.uint64(max(1, n * 3 // 2)), axis=1).astype(np.int64)
    steps = int(places.max()) + 1
    padded = np.append(h, np.uint64(0))
    walks = mixed(np.arange(1, REPEATS + 1, dtype=np.uint64) * SEED)
    at, written = np.zeros(REPEATS, np.int64), np.empty((steps, REPEATS), np.uint64)
    for t in range(steps):
        written[t] = padded[at]
        bit = mixed(written[t] ^ walks + np.uint64(t)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), len(h))
    key = walks + np.uint64(n)
    for k in range(SAMPLE):
        key = mixed(key + written[places[:, k], np.arange(REPEATS)])
    return key.view(np.int64).tolist()


def runs_of(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of an item, of which any passage within the allowed edits keeps one; just the first if none are allowed."""
    own = runs(np.array([word_hash_bytes(w) for w in words], np.uint64), run_length(len(words)) if allowed(len(words)) else len(words))
    return own if allowed(len(words)) else own[:1]


class Runs:
    """The runs of a block of items, sorted: for each length of run its hashes, where in an item it stands and how long the item is."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, sizes: np.ndarray):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            at = at[np.lexsort((offsets[at], sizes[at], hashes[at]))]
            self.of[length] = hashes[at], offsets[at], sizes[at]

    def places(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(start, size) of the windows over the words h that line up with a run of some item."""
        laid, first = set(), {}
        for length, (hashes, offsets, sizes) in self.of.items():
            own = runs(h, length)
            low = np.searchsorted(hashes, own)
            for i in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own).tolist():
                for m in range(int(low[i]), int(np.searchsorted(hashes, own[i], "right"))):
                    n = int(sizes[m])
                    if allowed(n):
                        laid.add((max(0, i - int(offsets[m])), n))
                    else:
                        first.setdefault((int(hashes[m]), n), (i, n))
        return sorted(laid | set(first.values()))


def windows_maker(items: Runs):
    """text -> its windows: start, size, words with a margin, keys, and a 128-bit digest of the window's own words."""
    hashes = Remembered(word_hash_bytes, 150_000)

    def windows(text: str | None) -> list[dict]:
        words = words_of(text)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        out = []
        for start, n in items.places(h):
            margin = allowed(n)
            low, high = max(0, start - margin), min(len(words), start + n + margin)
            content = xxhash.xxh3_128_intdigest(b" ".join(words[start : start + n])) & (1 << 126) - 1
            out.append({"start": low, "size": n, "passage": b" ".join(words[low:high]).decode("utf-8", "replace"), "keys": walk_keys(h[start : start + n], n), "c1": content >> 63, "c2": content & (1 << 63) - 1})
        return out

    return windows


def passage_distance(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Least word edits between item and a stretch of passage; where that stretch starts and ends."""
    m = len(passage)
    row, origin = [0] * (m + 1), list(range(m + 1))
    for i, word in enumerate(item, 1):
        diagonal, from_, row[0], origin[0] = row[0], origin[0], i, 0
        for j in range(1, m + 1):
            best, source = diagonal + (word != passage[j - 1]), from_
            if row[j] + 1 < best:
                best, source = row[j] + 1, origin[j]
            if row[j - 1] + 1 < best:
                best, source = row[j - 1] + 1, origin[j - 1]
            diagonal, from_, row[j], origin[j] = row[j], origin[j], best, source
    end = min(range(m + 1), key=lambda j: (row[j], j))
    return row[end], origin[end], end


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, words, n, keys, and the hashes of their runs in order, of the items that have a word."""

    def maker():
        def one(text: str | None) -> tuple:
            words = words_of(text)
            if not words:
                return "", 0, [], []
            keys = walk_keys(np.array([word_hash_bytes(w) for w in words], np.uint64), len(words))
            return b" ".join(words).decode("utf-8", "replace"), len(words), keys, runs_of(words).view(np.int64).tolist()

        return lambda texts: [*zip(*map(one, texts))]

    got = with_made(benchmark.select(F.col("item_id"), F.col("text")), "text", "words string, n int, keys array<long>, runs array<long>", maker).drop("text")
    return materialized(got.where(F.col("n") > 0).withColumn("item", F.monotonically_increasing_id()), "items")


def _block(items: DataFrame) -> Runs:
    """items: runs, n. Bounded by the words of a block: this is what goes to every executor."""
    rows = items.select(F.posexplode("runs").alias("offset", "run"), "n").distinct().toPandas()
    n = rows["n"].to_numpy(np.int64)
    lengths = np.array([run_length(x) if allowed(x) else x for x in n.tolist()], np.int64)
    return Runs(rows["run"].to_numpy(np.int64).view(np.uint64), lengths, rows["offset"].to_numpy(np.int64), n)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. One row per pair with a leak: doc_id, item_id, n_words (of the item), edits
    (of the nearest passage), start and end (its words in the document), n_windows (windows that were verified)."""
    docs = docs.select("doc_id", "text")
    items = _items(benchmark)
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    windows = None
    for block in range(blocks):
        own = docs.sparkSession.sparkContext.broadcast(_block(items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)))

        def maker(own=own):
            one = windows_maker(own.value)
            return lambda texts: [[*map(one, texts)]]

        laid = with_made(docs, "text", "windows array<struct<start:int,size:int,passage:string,keys:array<long>,c1:long,c2:long>>", maker)
        laid = laid.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.*")
        windows = laid if windows is None else windows.union(laid)
    windows = materialized(windows, "windows")

    # numbers of items meet contents; the words of both are fetched for what has met
    wanted = items.select("item", F.col("n").alias("size"), F.explode(F.array_distinct("keys")).alias("key"))
    content = ["size", "c1", "c2"]
    by_key = windows.select(*content, F.explode(F.array_distinct("keys")).alias("key")).distinct()
    found = by_key.join(wanted, ["size", "key"]).select(*content, "item").distinct()
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = windows.drop("keys").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    met = placed.join(salted, [*content, "salt"]).join(items.select("item", "item_id", "words"), "item")
    candidates = materialized(met.select("doc_id", "item_id", "start", "size", "passage", "words").distinct(), "candidates")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [passage_distance(w.split(" "), p.split(" ")) for w, p in zip(batch["words"], batch["passage"])]
            out = batch[["doc_id", "item_id", "start", "size"]].assign(edits=[x[0] for x in near], low=[x[1] for x in near], high=[x[2] for x in near])
            yield out[out["edits"] <= out["size"].map(allowed)] if len(out) else out

    id_, item = (df.schema[c].dataType.simpleString() for df, c in ((candidates, "doc_id"), (candidates, "item_id")))
    near = candidates.mapInPandas(checked, f"doc_id {id_}, item_id {item}, start int, size int, edits int, low int, high int")
    best = F.min(F.struct("edits", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))).alias("b")
    return near.groupBy("doc_id", "item_id").agg(F.first("size").cast("long").alias("n_words"), best, F.count("*").alias("n_windows")).select(
        "doc_id", "item_id", "n_words", F.col("b.edits").cast("long").alias("edits"), F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"), "n_windows"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
