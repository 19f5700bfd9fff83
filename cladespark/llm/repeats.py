"""Passages that repeat between documents: recompression of word sequences.

1. Words have names of 64 bits. A round names, in all documents alike, maximal runs of one symbol (by symbol and length), then
   pairs of neighbours of which the first is of the left half of all symbols and the second of the right half (a hash of the name
   and the round says which). A name follows from what it stands for, so tasks agree on it without a table, and equal passages
   get equal symbols but near their ends. Each symbol knows which words decide about it: its own, and those of the neighbours
   that it was not joined with (`c0` to `c1`).
2. A symbol of LONG words and more, with a second hash of its words, is counted over all documents: where a document with a smaller
   id has it, all of it repeats.
3. Every window of WINDOW words is known by the least of the symbols of level LEVEL (else a lower one) that words inside it
   decide about; equal windows have equal ones. Symbols of one document only need no more work. Windows of the others that
   are not inside a repeated long symbol are compared by hashes of their words (128 bits with the symbol's).
4. Words that are covered go.

Only symbols and hashes are shuffled for all documents, and texts of those that share a symbol. The least document of a key
is found with partial sums; a key that very many rows have is a skewed equi-join, which Spark splits. Texts with the same words
are one class: only the row with the least doc_id is looked at further, the words of the others all go.

Cases: null, empty and blank texts have no words; texts below WINDOW words keep all; texts of any length are taken whole; equal rows of
one doc_id have equal results and remove nothing from each other; rows of one doc_id with different texts are one document; a row
without doc_id comes after all others, and removes nothing; an empty table gives an empty one; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import Remembered, materialized, maybe_among, table, with_made, without, word_hash_bytes, words_of
from cladespark.llm.sketch import mixed

#: Words of a window, of a long symbol at least, and the level of the symbols that windows are known by.
WINDOW, LONG, LEVEL = 50, 64, 3
#: Words that are recompressed at once (a longer text alone), and rounds at most.
AT_ONCE, ROUNDS = 200_000, 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
BASE = 0xE7037ED1A0B428DB
#: The doc_id of rows without one: after all others.
LAST = (1 << 63) - 1


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


class Symbols:
    """The symbols of one level over a row of words: names, their first word and the one after their last, and c0 to c1."""

    def __init__(self, name: np.ndarray, x0: np.ndarray, x1: np.ndarray, c0: np.ndarray, c1: np.ndarray, fixed: np.ndarray):
        self.name, self.x0, self.x1, self.c0, self.c1, self.fixed = name, x0, x1, c0, c1, fixed

    def runs(self) -> Symbols:
        """Runs of one symbol named. That a run ends is known from its neighbours."""
        head = np.flatnonzero(np.r_[True, self.name[1:] != self.name[:-1]])
        times = np.diff(np.r_[head, len(self.name)])
        tail = head + times - 1
        name = np.where(times > 1, mixed(self.name[head] * _ODD[0] + times.astype(np.uint64) * _ODD[1]), self.name[head])
        return Symbols(name, self.x0[head], self.x1[tail], self.c0[np.maximum(head - 1, 0)], self.c1[np.minimum(tail + 1, len(self.name) - 1)], self.fixed[head])

    def pairs(self, turn: int) -> Symbols:
        """Pairs of a left and a right symbol named; fixed ones are neither. That a left symbol is alone is known from the next, that a
        right one is from the one before."""
        right = mixed(self.name + np.uint64(turn * int(_ODD[4]) & (1 << 64) - 1)) >> np.uint64(63) == 1
        left, right = ~right & ~self.fixed, right & ~self.fixed
        opens = np.r_[left[:-1] & right[1:], False]
        kept = ~np.r_[False, opens[:-1]]
        after = np.minimum(np.arange(len(opens)) + 1, len(opens) - 1)
        name = np.where(opens, mixed(self.name * _ODD[2] + self.name[after] * _ODD[3]), self.name)
        c0 = np.where(right, np.r_[self.c0[:1], self.c0[:-1]], self.c0)
        c1 = np.where(left, self.c1[after], self.c1)
        return Symbols(name[kept], self.x0[kept], np.where(opens, self.x1[after], self.x1)[kept], c0[kept], c1[kept], self.fixed[kept])


class Recompressed:
    """Documents (arrays of word hashes) one behind the other, with a fixed symbol of its own before, between and after them."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.cumsum(np.r_[0, sizes[:-1] + 1]) + 1
        self.ends = self.starts + sizes
        n = int(self.ends[-1]) + 1
        word, fixed = np.zeros(n, np.uint64), np.ones(n, bool)
        for d, a, b in zip(docs, self.starts.tolist(), self.ends.tolist()):
            word[a:b], fixed[a:b] = d, False
        at = np.flatnonzero(fixed)
        word[at] = mixed(at.astype(np.uint64) + _ODD[3])
        places = np.arange(n)
        self.own = Symbols(word, places, places + 1, places, places + 1, fixed)
        up, down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        self._sums, self._down = np.r_[np.uint64(0), np.cumsum(word * up[:n], dtype=np.uint64)], down
        self.levels, self.long = [self.own], []
        self._rounds()
        open_ = np.r_[0, np.cumsum(fixed)]
        self.windows = np.flatnonzero(open_[WINDOW:] == open_[:-WINDOW]) if n >= WINDOW else np.zeros(0, np.int64)

    def content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words from a to before b, wherever they stand."""
        return mixed((self._sums[b] - self._sums[a]) * self._down[a])

    def _rounds(self) -> None:
        level = self.own
        for turn in range(1, ROUNDS):
            level = level.runs().pairs(turn)
            if turn <= LEVEL:
                self.levels.append(level)
            if turn % 2 == 0:
                new = np.flatnonzero(level.x1 - level.x0 >= LONG)
                self.long.append((level.name[new], level.x0[new], level.x1[new]))
            if len(level.name) <= 2 * len(self.starts) + 1 and turn >= LEVEL and turn % 2 == 0:
                break
        name, x0, x1 = (np.concatenate(v) for v in zip(*self.long))
        # a symbol that lives for several rounds counts once
        order = np.lexsort((x1, x0))
        name, x0, x1 = name[order], x0[order], x1[order]
        once = np.r_[True, (x0[1:] != x0[:-1]) | (x1[1:] != x1[:-1])] if len(x0) else np.zeros(0, bool)
        self.long = name[once], self.content(x0[once], x1[once]), x0[once], x1[once]

    def keys(self) -> np.ndarray:
        """For each window the least symbol, with the words that decide about it, of the highest level that has one inside it."""
        out, left = np.zeros(len(self.windows), np.uint64), np.arange(len(self.windows))
        for level in reversed(self.levels):
            at = self.windows[left]
            low, high = np.searchsorted(level.c0, at), np.searchsorted(level.c1, at + WINDOW, "right")
            has = high > low
            least = [mixed(level.name + self.content(level.c0, level.c1))]
            low, size = low[has], (high - low)[has]
            step = np.log2(np.maximum(size, 1)).astype(np.int64)
            for k in range(int(step.max(initial=0))):
                half = 1 << k
                least.append(np.minimum(least[k][: len(least[k]) - half], least[k][half:]))
            made = np.zeros(len(low), np.uint64)
            for k, values in enumerate(least):
                own = step == k
                made[own] = np.minimum(values[low[own]], values[low[own] + size[own] - (1 << k)])
            out[left[has]] = made
            left = left[~has]
            if not len(left):
                break
        return out


def in_portions(texts: list, columns: int, work) -> list:
    """work(words of each text, indexes) -> rows, for texts of about AT_ONCE words together; rows of `columns` values, in order."""
    rows, some, held = [None] * len(texts), [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        some.append((k, words))
        held += len(words)
        if held >= AT_ONCE or k == len(texts) - 1:
            for (j, _), row in zip(some, work([w for _, w in some], [j for j, _ in some])):
                rows[j] = row
            some, held = [], 0
    return [*zip(*rows)] if rows else [[] for _ in range(columns)]


class Hashed:
    def __init__(self):
        self.of = Remembered(word_hash_bytes, 150_000)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words))


def _per_document(starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> Iterator[slice]:
    """Where the sorted places of each document stand."""
    for a, b in zip(np.searchsorted(places, starts).tolist(), np.searchsorted(places, ends).tolist()):
        yield slice(a, b)


def symbols(docs: DataFrame) -> DataFrame:
    """docs: text. Adds keys (of its windows, once each) and the long symbols a, b (name, hash of the words)."""

    def maker():
        hashed = Hashed()

        def work(texts: list, _: list) -> list:
            made = Recompressed([hashed(w) for w in texts])
            keys, (a, b, x0, _) = made.keys().view(np.int64), made.long
            near, far = _per_document(made.starts, made.ends, made.windows), _per_document(made.starts, made.ends, x0)
            return [(np.unique(keys[i]), a[j].view(np.int64), b[j].view(np.int64)) for i, j in zip(near, far)]

        return lambda texts: in_portions(texts, 3, work)

    return with_made(docs, "text", "keys array<long>, a array<long>, b array<long>", maker)


def laid(docs: DataFrame) -> DataFrame:
    """docs: doc (with text, and of its document the shared keys and the long symbols that an earlier one has, a and b). Adds h1, h2 and at: the windows
    that are left to compare, and low, high: the stretches of the long symbols."""

    def maker():
        hashed = Hashed()

        def work(rows: list[dict]) -> list:
            some, held, out = [], 0, []
            for k, row in enumerate(rows):
                words = words_of(row["text"])
                some.append((row, words))
                held += len(words)
                if held >= AT_ONCE or k == len(rows) - 1:
                    out += placed(some)
                    some, held = [], 0
            return [*zip(*out)]

        def placed(some: list) -> list:
            made = Recompressed([hashed(w) for _, w in some])
            keys, (a, b, x0, x1) = made.keys(), made.long
            content, symbol, out = made.content(made.windows, made.windows + WINDOW).view(np.int64), mixed(a) + b, []
            near, far = _per_document(made.starts, made.ends, made.windows), _per_document(made.starts, made.ends, x0)
            for (row, _), start, i, j in zip(some, made.starts.tolist(), near, far):
                shared, ra, rb = (np.array(row[c] or [], np.int64).view(np.uint64) for c in ("keys", "a", "b"))
                hit = np.isin(symbol[j], mixed(ra) + rb)
                low, high = x0[j][hit] - start, x1[j][hit] - start
                at = made.windows[i] - start
                # inside one of the stretches: the one that reaches farthest of those that begin before
                order = np.argsort(low, kind="stable")
                reach = np.maximum.accumulate(np.r_[np.int64(0), high[order]])
                inside = reach[np.searchsorted(low[order], at, "right")] >= at + WINDOW
                ask = ~inside & np.isin(keys[i], shared)
                out.append((at[ask], keys[i][ask].view(np.int64), content[i][ask], low, high))
            return out

        return work

    return with_made(docs, "doc", "at array<int>, h1 array<long>, h2 array<long>, low array<int>, high array<int>", maker)


def covered(docs: DataFrame) -> DataFrame:
    """docs: doc (with text, at, h2, low, high, and found: the hashes h2 of windows that an earlier document has). Adds n_removed, kept_sha256."""

    def maker():
        def one(row: dict) -> tuple:
            words = words_of(row["text"])
            change = np.zeros(len(words) + 1, np.int64)
            at = np.array(row["at"], np.int64)[np.isin(np.array(row["h2"], np.int64), np.array(row["found"] or [], np.int64))]
            for low, high in ((at, at + WINDOW), (np.array(row["low"], np.int64), np.array(row["high"], np.int64))):
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
            kept = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist()) if not c]
            return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

        return lambda rows: [*zip(*map(one, rows))]

    return with_made(docs, "doc", "n_removed long, kept_sha256 string", maker)


def digests(docs: DataFrame) -> DataFrame:
    """docs: text. Adds n_words, sha256 (of the words, joined by one space) and its first 128 bits as d1, d2."""

    def maker():
        def one(text: str | None) -> tuple:
            words = words_of(text)
            digest = hashlib.sha256(b" ".join(words))
            d1, d2 = np.frombuffer(digest.digest()[:16], np.int64).tolist()
            return len(words), digest.hexdigest(), d1, d2

        return lambda texts: [*zip(*map(one, texts))]

    return with_made(docs, "text", "n_words long, sha256 string, d1 long, d2 long", maker)


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256. A word goes if a window over it also starts in a document of
    a smaller doc_id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(LAST)).cast("long").alias("doc"), F.col(text).alias("text"))
    row = F.concat_ws(":", "doc", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    rows = rows.withColumn("row", row)
    keyed = materialized(digests(rows).drop("text"), "digests")
    first = keyed.where(F.col("n_words") >= WINDOW).groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = materialized(keyed.join(first, ["d1", "d2"]).where(F.col("doc") > F.col("least")).select("row").distinct(), "copies")
    short = keyed.where(F.col("n_words") < WINDOW).select("row").distinct()
    own = without(rows.select("row", "doc", "text"), "row", copies)

    named = materialized(symbols(own.select("row", "doc", "text")).drop("text", "row"), "symbols")
    keys = named.select("doc", F.explode("keys").alias("key"))
    both = keys.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key")
    shared = keys.join(both, "key").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    long = named.select("doc", F.explode(F.arrays_zip("a", "b")).alias("z")).select("doc", "z.a", "z.b")
    least = long.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("a", "b", "least")
    earlier = long.join(least, ["a", "b"]).where(F.col("doc") > F.col("least")).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("long"))
    # a long symbol has windows, so a document that shares one shares a key
    wanted = materialized(shared.join(earlier, "doc", "left").select("doc", "keys", F.col("long.a").alias("a"), F.col("long.b").alias("b")), "shared")

    asked = maybe_among(own, "doc", wanted.select("doc")).join(wanted, "doc")
    places = materialized(laid(asked.select("row", F.col("doc").alias("id"), F.struct("text", "keys", "a", "b").alias("doc"))).select("row", F.col("id").alias("doc"), F.col("doc.text").alias("text"), "at", "h1", "h2", "low", "high"), "places")
    windows = places.select("doc", F.explode(F.arrays_zip("h1", "h2")).alias("z")).select("doc", "z.h1", "z.h2")
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h1", "h2", "least")
    found = windows.join(least, ["h1", "h2"]).where(F.col("doc") > F.col("least")).groupBy("doc").agg(F.collect_set("h2").alias("found"))
    found = materialized(found, "found")

    hit = places.join(found, "doc", "left").where(F.col("found").isNotNull() | (F.size("low") > 0))
    gone = covered(hit.select("row", F.struct("text", "at", "h2", "low", "high", "found").alias("doc"))).select("row", "n_removed", "kept_sha256")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    gone = materialized(gone.dropDuplicates(["row"]).unionByName(copies.select("row", F.lit(-1).cast("long").alias("n_removed"), nothing.alias("kept_sha256"))), "removed")
    # only rows that lose a word are joined
    sound = without(keyed, "row", gone.select("row")).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    lost = maybe_among(keyed, "row", gone.select("row")).join(gone, "row")
    lost = lost.select("doc_id", "n_words", F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), "kept_sha256")
    return sound.unionByName(lost)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE = f"""WITH given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS doc, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, doc, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM given),
windows AS (SELECT r, doc, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM words QUALIFY i + {WINDOW} <= n),
first AS (SELECT s, min(doc) AS least FROM windows GROUP BY s),
hits AS (SELECT r, i FROM windows JOIN first USING (s) WHERE least < doc),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM hits),
kept AS (SELECT r, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY i)) AS s FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, coalesce(s, sha256('')) AS kept_sha256 FROM given LEFT JOIN kept USING (r)"""

QUERIES = {"op12_substring_dedup": op12_substring_dedup}
ORACLES = {"op12_substring_dedup": ORACLE}
