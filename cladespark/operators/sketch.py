"""Bottom-s sketches of canonical k-mers, and the Mash distance of sketches.

A sketch keeps the s smallest hashes of all k-mers with their repetitions; a shorter one is filled up with the largest
hash value, and the filling takes part in comparisons, as it does in the engine whose results these match. `dedup=True`
gives textbook sketches instead: distinct hashes, no filling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cladespark.functions.murmur import SEED, biased, murmur_low
from cladespark.functions.nucleotides import pieces
from cladespark.operators.distance import Metric
from cladespark.sources.shared import materialized

PAD = np.iinfo(np.int64).max
_complement = str.maketrans("ACGT", "TGCA")
_codes = np.zeros(256, np.uint64)
_codes[[ord(c) for c in "ACGT"]] = range(4)
#: Start positions whose k-mers are hashed at once.
AT_ONCE = 1 << 18


def _codes_of(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters of a sequence and of its reverse complement, and the numbers of all k-mers of each (in order of the letters: the
    lesser number is the lesser string), the second in the order of the first."""
    if k > 31:
        raise ValueError("k-mers of up to 31 bases")
    n = len(seq) - k + 1
    ahead = np.frombuffer(seq.encode("ascii"), np.uint8)
    back = np.frombuffer(seq.translate(_complement)[::-1].encode("ascii"), np.uint8)
    number = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for j in range(k):
        for v, bases in zip(number, (ahead, back)):
            v <<= np.uint64(2)
            v |= _codes[bases[j : j + n]]
    return ahead, back, number[0], number[1][::-1]


def sequence_hashes(seq: str, k: int, seed: int = SEED) -> np.ndarray:
    """Biased hashes of the canonical k-mers of a sequence of A, C, G and T (k up to 31), in order."""
    n = len(seq) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    ahead, back, own, other = _codes_of(seq, k)
    lesser = own <= other
    windows, others = np.lib.stride_tricks.sliding_window_view(ahead, k), np.lib.stride_tricks.sliding_window_view(back, k)[::-1]
    parts = [murmur_low(np.where(lesser[i : i + AT_ONCE, None], windows[i : i + AT_ONCE], others[i : i + AT_ONCE]), seed) for i in range(0, n, AT_ONCE)]
    return biased(np.concatenate(parts))


def kmer_table(sequences: DataFrame, k: int = 15, piece: int = 1 << 16) -> DataFrame:
    """sequences: seq (A, C, G, T). kmer, n: how often each canonical k-mer occurs in all of them (k up to 31).

    Each batch of pieces is counted as two-bit numbers before anything is shuffled; numbers become strings when all are counted."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = [np.minimum(*_codes_of(part, k)[2:]) for part in batch["part"]]
            code, n = np.unique(np.concatenate(numbers), return_counts=True) if numbers else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pd.DataFrame({"code": code.view(np.int64), "n": n})

    parts = sequences.select(F.explode(pieces(F.col("seq"), k, piece)).alias("part")).repartition(2 * sequences.sparkSession.sparkContext.defaultParallelism)
    counts = parts.mapInPandas(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    letters = F.transform(F.sequence(F.lit(2 * k - 2), F.lit(0), F.lit(-2)), lambda s: F.get(F.array(*map(F.lit, "ACGT")), F.call_function("shiftright", F.col("code"), s).bitwiseAND(3).cast("int")))
    return counts.select(F.array_join(letters, "").alias("kmer"), "n")


#: K-mer starts of a piece of a sequence, and pieces that are merged at once.
PIECE, MERGED = 1 << 20, 64


def bottom(hashes: np.ndarray, size: int, dedup: bool) -> np.ndarray:
    return (np.unique(hashes) if dedup else np.sort(hashes))[:size]


def sketches(sequences: DataFrame, k: int = 15, size: int = 1000, seed: int = SEED, dedup: bool = False, piece: int = PIECE, least: int = 1) -> DataFrame:
    """sequences: seq_id (once each), seq (A, C, G, T). One row each: seq_id, n_kmers, sketch (sorted biased hashes, without filling).

    Sequences of up to `piece` k-mers are sketched in place. A longer one is cut into pieces that overlap by k - 1 bases, each a
    row of its own; the smallest hashes of the pieces hold those of the whole, so sketches are merged, MERGED at a time and then all. least: hashes that occur less often in a sequence are left out (of its sketch, not of n_kmers); these are counted over
    the whole sequence by a shuffle of (sequence, hash)."""

    @pandas_udf("n_kmers long, sketch array<long>")
    def sketch(seqs: pd.Series) -> pd.DataFrame:
        hashes = [sequence_hashes(seq or "", k, seed) for seq in seqs]
        return pd.DataFrame([(len(h), bottom(h, size, dedup)) for h in hashes], columns=["n_kmers", "sketch"])

    if least > 1:
        return _frequent(sequences, k, size, seed, dedup, piece, least)
    starts = F.length("seq") - (k - 1)
    short = sequences.where(F.coalesce(starts <= piece, F.lit(True)))
    here = short.select("seq_id", sketch("seq").alias("s")).select("seq_id", "s.*")
    long = sequences.where(starts > piece)
    cut = _pieces(long, k, piece)
    parts = cut.select("seq_id", "at", sketch("part").alias("s")).select("seq_id", "at", "s.*")
    # a string has 2^31 letters at most, so few groups are left for the second time
    parts = _merged(_merged(parts, size, dedup, F.floor(F.col("at") / MERGED)), size, dedup, F.lit(0).cast("long"))
    return here.unionByName(parts.select("seq_id", "n_kmers", "sketch"))


def _pieces(sequences: DataFrame, k: int, piece: int) -> DataFrame:
    """seq_id, at (number of the piece), part: stretches with `piece` k-mer starts each (the last with what is left), dealt anew."""
    n = F.ceil((F.length("seq") - (k - 1)) / piece)
    at = sequences.where(F.length("seq") >= k).select("seq_id", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("at"))
    return at.select("seq_id", "at", F.substring(F.col("seq"), (F.col("at") * piece + 1).cast("int"), F.lit(piece + k - 1)).alias("part")).repartition("seq_id", "at")


def _merged(parts: DataFrame, size: int, dedup: bool, at: Column) -> DataFrame:
    kind = parts.schema["seq_id"].dataType.simpleString()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq_id": [key[0]], "at": [key[1]], "n_kmers": [rows["n_kmers"].sum()], "sketch": [bottom(np.concatenate(rows["sketch"].to_numpy()), size, dedup)]})

    return parts.withColumn("at", at).groupBy("seq_id", "at").applyInPandas(merge, f"seq_id {kind}, at long, n_kmers long, sketch array<long>")


def _frequent(sequences: DataFrame, k: int, size: int, seed: int, dedup: bool, piece: int, least: int) -> DataFrame:
    @pandas_udf("h array<long>, n array<long>")
    def counted(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([np.unique(sequence_hashes(p, k, seed), return_counts=True) for p in parts], columns=["h", "n"])

    each = _pieces(sequences, k, piece).select("seq_id", counted("part").alias("c")).select("seq_id", F.explode(F.arrays_zip("c.h", "c.n")).alias("z"))
    counts = materialized(each.groupBy("seq_id", F.col("z.h").alias("h")).agg(F.sum("z.n").alias("n")), "kmer-counts")
    totals = counts.groupBy("seq_id").agg(F.sum("n").alias("n_kmers"))
    low = Window.partitionBy("seq_id").orderBy("h")
    few = counts.where(F.col("n") >= least).withColumn("r", F.row_number().over(low)).where(F.col("r") <= size)
    repeated = few.select("seq_id", F.struct("h", (F.lit(1) if dedup else F.least("n", F.lit(size))).alias("n")).alias("x")).groupBy("seq_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    hashes = F.slice(F.flatten(F.transform("x", lambda x: F.array_repeat(x["h"], x["n"].cast("int")))), 1, size)
    got = sequences.select("seq_id").join(totals, "seq_id", "left").join(repeated, "seq_id", "left")
    return got.select("seq_id", F.coalesce("n_kmers", F.lit(0)).cast("long").alias("n_kmers"), F.coalesce(hashes, F.array().cast("array<bigint>")).alias("sketch"))


def filled(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.append(sketch[:size], np.full(size - len(sketch[:size]), PAD))


def shared_hashes(a: np.ndarray, b: np.ndarray, size: int, fill: bool = True) -> int:
    """How many of the first `size` merged hashes both sketches hold; a is the sketch with the smaller ordinal."""
    if fill:
        a, b = filled(a, size), filled(b, size)
    values, first = np.unique(a, return_index=True)
    low, high = np.searchsorted(b, values), np.searchsorted(b, values, "right")
    both = high - low
    # hashes before a value: those of a, and those of b that a does not have
    before = first + low - (np.cumsum(both) - both)
    return int(both[before < size].sum())


def mash_distance(shared: int, size: int, k: int) -> float:
    """At least one shared hash is assumed, and the distance is at most 1."""
    j = max(shared, 1) / max(size, 1)
    return min(1.0, abs(math.log(2 * j / (1 + j)) / k))


def _entries(rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, hash, place of its first occurrence, occurrences) of each distinct hash of each sketch (sorted)."""
    n = np.array([len(v) for v in rows], np.int64)
    row, values = np.repeat(np.arange(len(rows)), n), np.concatenate([*rows, np.zeros(0, np.int64)])
    at = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (row[1:] != row[:-1])][: len(values)])
    return row[at], values[at], at - (np.cumsum(n) - n)[row[at]], np.diff(np.r_[at, len(values)])


def crossed_shared(x: list[np.ndarray], y: list[np.ndarray], first: np.ndarray, size: int) -> np.ndarray:
    """shared_hashes of all pairs of two lists of sketches (without filling), filled; first: where that of x is the first of the pair."""
    return Crossed(y, size).shared(x, first)


class Crossed:
    """shared_hashes of sketches with a list of others, whose hashes are put in order once.

    Only hashes that both hold count, so the pairs of a hash are made by a join of the two lists and summed up by pair. Where the union of a
    pair is larger than a sketch, its hashes have to be in order as well: those after the first `size` don't count."""

    def __init__(self, y: list[np.ndarray], size: int):
        j, hashes, place, times = _entries(y)
        order = np.argsort(hashes, kind="stable")
        self.j, self.place, self.times, self.size = j[order], place[order], times[order], size
        self.hashes, self.start = np.unique(hashes[order], return_index=True)
        self.end = np.r_[self.start[1:], len(order)] if len(order) else self.start
        self.n, self.once = np.array([len(v) for v in y], np.int64), not len(times) or times.max() == 1

    def shared(self, x: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        size, m, ny = self.size, len(self.n), self.n[None]
        nx = np.array([len(v) for v in x], np.int64)[:, None]
        i, hashes, place, times = _entries(x)
        if not len(i) or not len(self.hashes):
            i, hashes, place, times = i[:0], hashes[:0], place[:0], times[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        met = np.flatnonzero(self.hashes[at] == hashes) if len(hashes) else at
        low = self.start[at[met]]
        n = self.end[at[met]] - low
        left = np.repeat(met, n)
        right = np.arange(len(left)) + np.repeat(low - (np.cumsum(n) - n), n)
        pair = i[left] * m + self.j[right]
        cells, counted = len(x) * m, np.ones(len(left), np.int64)
        if not self.once or (len(times) and times.max() > 1):
            counted = np.where(first.ravel()[pair], self.times[right], times[left])
        both = np.bincount(pair, counted, cells).astype(np.int64)
        shared, large = both.reshape(len(x), m).copy(), (nx + ny).ravel() - both > size
        if large.any():
            some = np.flatnonzero(large[pair])
            some = some[np.argsort(pair[some], kind="stable")]  # within a pair the hashes stay in order
            pair, left, right, counted = pair[some], left[some], right[some], counted[some]
            sums = np.cumsum(counted) - counted
            start = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, bool)
            earlier = sums - np.repeat(sums[start], np.diff(np.r_[np.flatnonzero(start), len(pair)])) if len(pair) else sums
            before = place[left] + self.place[right] - earlier
            shared = np.where(large, np.bincount(pair, np.where(before < size, counted, 0), cells).astype(np.int64), both).reshape(len(x), m)
        # the filling is one more hash that all shorter sketches share
        fill = np.where(first, size - ny, size - nx)
        return shared + np.where((nx < size) & (ny < size) & (nx + ny - both.reshape(len(x), m) < size), fill, 0)


def sketch_metric(k: int = 15, size: int = 1000, column: str = "sketch") -> Metric:
    """Mash distances of filled sketches; the row that comes first by turn (if there is one) and ord gives the first sketch of a pair."""

    def metric(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x, y = ([np.asarray(v, np.int64)[:size] for v in rows[column]] for rows in (a, b))
        names = [c for c in ("turn", "ord") if c in a]
        every = pd.concat([a[names], b[names]], ignore_index=True)
        rank = every.groupby(names, sort=True).ngroup().to_numpy() if len(every) else np.zeros(0, int)
        p, q = rank[: len(a)], rank[len(a) :]
        out = np.zeros((len(x), len(y)))
        for t in range(0, len(y), 512):
            others = Crossed(y[t : t + 512], size)
            for s in range(0, len(x), 32):
                shared = others.shared(x[s : s + 32], p[s : s + 32, None] < q[None, t : t + 512])
                j = np.maximum(shared, 1) / size
                out[s : s + 32, t : t + 512] = np.minimum(1.0, np.abs(np.log(2 * j / (1 + j)) / k))
        out[p[:, None] == q[None]] = 0.0
        return out

    return metric


def mash_pairs(pairs: DataFrame, sketched: DataFrame, k: int = 15, size: int = 1000, dedup: bool = False) -> DataFrame:
    """pairs: i, j (seq ids, each pair once). Adds shared (long) and d (double): the sketch of the smaller id is compared with the other's.
    dedup: textbook sketches, compared on the `size` least hashes of their union or all of it."""

    @pandas_udf("shared long, d double")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
            shared = shared_hashes(x, y, size, not dedup)
            out.append((shared, mash_distance(shared, min(size, len(np.union1d(x, y))) if dedup else size, k)))
        return pd.DataFrame(out, columns=["shared", "d"])

    left = sketched.select(F.col("seq_id").alias("i"), F.col("sketch").alias("a"))
    right = sketched.select(F.col("seq_id").alias("j"), F.col("sketch").alias("b"))
    both = pairs.join(left, "i").join(right, "j")
    first = F.col("i") <= F.col("j")
    both = both.withColumn("m", compared(F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))))
    return both.select("i", "j", "m.*")


#: Letters up to which a sequence is no larger than its sketch for each of its hashes, so that it is sent instead.
LETTERS = 8
#: Ids of a block of given pairs, queries and sequences that one task of a search holds, sequences that it compares at once, and candidates that
#: it keeps before they are cut to the best.
IDS, ASKED, SEARCHED, TOGETHER, KEPT = 256, 4000, 8000, 256, 1 << 18


def carried(sequences: DataFrame, k: int, size: int, dedup: bool) -> DataFrame:
    """sequences: seq_id, seq. seq_id and what tasks that compare them need: seq, or, where that is longer than a sketch, sketch."""
    parts = 2 * sequences.sparkSession.sparkContext.defaultParallelism
    own = materialized(sequences.select("seq_id", F.coalesce("seq", F.lit("")).alias("seq")).repartition(parts), "sequences")
    short = F.length("seq") <= LETTERS * size
    long = sketches(own.where(~short), k, size, dedup=dedup).select("seq_id", F.lit(None).cast("string").alias("seq"), "sketch")
    return own.where(short).withColumn("sketch", F.lit(None).cast("array<bigint>")).unionByName(long)


def _sketched(rows: pd.DataFrame, k: int, size: int, dedup: bool) -> list[np.ndarray]:
    return [bottom(sequence_hashes(seq, k), size, dedup) if isinstance(seq, str) else np.asarray(made, np.int64) for seq, made in zip(rows["seq"], rows["sketch"])]


def mash_given(pairs: DataFrame, sequences: DataFrame, k: int = 15, size: int = 1000, dedup: bool = False, ids: int = IDS) -> DataFrame:
    """As mash_pairs, of sequences (seq_id, a whole number; seq). A pair goes to the task of its two blocks of ids, which gets each sequence once and
    sketches it there: a sketch has eight bytes for each letter, and goes to no disk."""
    block = lambda c: F.floor(F.col(c) / ids).alias(f"__{c}")
    dealt = pairs.select(F.col("i").cast("long"), F.col("j").cast("long"), block("i"), block("j"))
    needed = dealt.select("__i", "__j", F.explode(F.array("i", "j")).alias("seq_id")).distinct()
    held = needed.join(carried(sequences, k, size, dedup).withColumn("seq_id", F.col("seq_id").cast("long")), "seq_id").withColumn("j", F.lit(-1).cast("long"))
    rows = held.select("__i", "__j", F.lit(False).alias("pair"), F.col("seq_id").alias("i"), "j", "seq", "sketch")
    rows = rows.unionByName(dealt.withColumn("pair", F.lit(True)), allowMissingColumns=True)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        of, asked = rows[~rows["pair"]], rows[rows["pair"]]
        sketch = dict(zip(of["i"].tolist(), _sketched(of, k, size, dedup)))
        out = []
        for i, j in zip(asked["i"].tolist(), asked["j"].tolist()):
            if i in sketch and j in sketch:
                x, y = sketch[min(i, j)], sketch[max(i, j)]
                shared = shared_hashes(x, y, size, not dedup)
                out.append((i, j, shared, mash_distance(shared, min(size, len(np.union1d(x, y))) if dedup else size, k)))
        return pd.DataFrame(out, columns=["i", "j", "shared", "d"])

    return rows.groupBy("__i", "__j").applyInPandas(compare, "i long, j long, shared long, d double")


class Nearest:
    """The `most` nearest of queries among sequences that come in parts, by textbook sketches."""

    def __init__(self, ids: np.ndarray, asked: list[np.ndarray], k: int, size: int, most: int):
        self.ids, self.asked, self.k, self.size, self.most = ids, asked, k, size, most
        self.n = np.array([len(v) for v in asked], np.int64)
        self.hashes, self.of = np.concatenate([*asked, np.zeros(0, np.int64)]), np.repeat(np.arange(len(asked)), self.n)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.of = self.hashes[order], self.of[order]
        #: The largest shares so far, per query, ascending; a pair whose share can't come up to the least of them is none of the nearest.
        self.best = np.zeros((len(asked), most))
        self.found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]

    def take(self, ids: np.ndarray, sketches: list[np.ndarray]) -> None:
        n, size = np.array([len(v) for v in sketches], np.int64), self.size
        hashes, doc = np.concatenate([*sketches, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sketches)), n)
        low = np.searchsorted(self.hashes, hashes)
        times = np.searchsorted(self.hashes, hashes, "right") - low
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        common = np.bincount(self.of[at] * len(n) + np.repeat(doc, times), minlength=len(self.n) * len(n))
        cell = np.flatnonzero(common)
        q, j = cell // len(n), cell % len(n)
        other = self.ids[q] != ids[j]
        q, j, c = q[other], j[other], common[cell[other]]
        union = self.n[q] + n[j] - c
        held = np.minimum(union, size)
        exact = union <= size
        # the least `size` hashes of a larger union hold at most the shared ones
        held = np.minimum(union, size)
        top = c / held
        self._raise(q[exact], top[exact])
        exact &= top >= self.best[q, 0] - 1e-12
        self._keep(q[exact], ids[j[exact]], c[exact], held[exact])
        todo = np.flatnonzero((union > size) & (top >= self.best[q, 0] - 1e-12))
        todo = todo[np.argsort(-top[todo], kind="stable")]
        for s in range(0, len(todo), 1024):  # those that may be nearest first, which leaves out most others
            part = todo[s : s + 1024]
            part = part[top[part] >= self.best[q[part], 0] - 1e-12]
            if len(part):
                shared = np.array([shared_hashes(self.asked[a], sketches[b], size, False) for a, b in zip(q[part].tolist(), j[part].tolist())])
                self._raise(q[part], np.maximum(shared, 1) / size)
                self._keep(q[part], ids[j[part]], shared, held[part])

    def _raise(self, q: np.ndarray, share: np.ndarray) -> None:
        """The `most` largest of the shares and those before, per query; ascending."""
        more = share > self.best[q, 0]
        rows = np.concatenate([np.repeat(np.arange(len(self.n)), self.most), q[more]])
        values = np.concatenate([self.best.ravel(), share[more]])
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        last = np.searchsorted(rows, np.arange(len(self.n)), "right")
        self.best = values[last[:, None] - np.arange(self.most, 0, -1)]

    def _keep(self, q: np.ndarray, j: np.ndarray, shared: np.ndarray, held: np.ndarray) -> None:
        share = np.maximum(shared, 1) / held
        d = np.round(np.minimum(1.0, np.abs(np.log(2 * share / (1 + share)) / self.k)), 9)
        self.found = [np.concatenate(v) for v in zip(self.found, (q, j, shared, d))]
        if len(self.found[0]) > max(KEPT, 2 * self.most * len(self.n)):
            self.cut()

    def cut(self) -> None:
        q, j, _, d = self.found
        order = np.lexsort((j, d, q))
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        self.found = [v[order[rank < self.most]] for v in self.found]

    def rows(self) -> pd.DataFrame:
        self.cut()
        q, j, shared, d = self.found
        return pd.DataFrame({"i": self.ids[q], "j": j, "shared": shared, "d": d})


def mash_search(queries: DataFrame, sequences: DataFrame, k: int = 15, size: int = 1000, most: int = 5, asked: int = ASKED, searched: int = SEARCHED) -> DataFrame:
    """The `most` nearest sequences of each query (queries: seq_id) among all others (sequences: seq_id, a whole number; seq): i, j, shared, d, rank, by
    textbook sketches. Ties go to the smaller id.

    Each portion of the queries meets each portion of the sequences in a task, which sketches both and counts shared hashes by a sorted list of
    those of the queries. That number bounds the distance from both sides (it is the distance where the union is no
    larger than a sketch), so only pairs that can be among the nearest are compared by their sketches, and a task gives `most` rows for
    each query. Pairs that share nothing all have the same largest distance; the smallest ids stand for them."""
    own = materialized(carried(sequences, k, size, True).withColumn("seq_id", F.col("seq_id").cast("long")), "carried")
    ids = materialized(queries.select(F.col("seq_id").cast("long").alias("seq_id")).distinct(), "queries")
    portions, blocks = max(1, -(-ids.count() // asked)), max(own.sparkSession.sparkContext.defaultParallelism, -(-own.count() // searched))
    deal = lambda n, salt: F.pmod(F.xxhash64("seq_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.join(ids, "seq_id", "left_semi").select(deal(portions, 1).alias("__a"), every(blocks).alias("__b"), F.lit(True).alias("query"), "seq_id", "seq", "sketch")
    right = own.select(every(portions).alias("__a"), deal(blocks, 2).alias("__b"), F.lit(False).alias("query"), "seq_id", "seq", "sketch")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        own, others = rows[rows["query"]], rows[~rows["query"]]
        nearest = Nearest(own["seq_id"].to_numpy(), _sketched(own, k, size, True), k, size, most)
        for at in range(0, len(others), TOGETHER):
            part = others.iloc[at : at + TOGETHER]
            nearest.take(part["seq_id"].to_numpy(), _sketched(part, k, size, True))
        return nearest.rows()

    found = materialized(left.unionByName(right).groupBy("__a", "__b").applyInPandas(search, "i long, j long, shared long, d double"), "nearest")
    # among so many least ids are enough others; one that shares hashes but was left out of its task's rows has enough nearer ones before it
    least = F.array(*[F.lit(r.seq_id).cast("long") for r in own.select("seq_id").orderBy("seq_id").limit(2 * most).collect()])
    rest = ids.select(F.col("seq_id").alias("i"), F.explode(least).alias("j")).where("i <> j").join(found.select("i", "j"), ["i", "j"], "left_anti")
    rest = rest.join(own.select(F.col("seq_id").alias("i")), "i", "left_semi")
    rest = rest.select("i", "j", F.lit(0).cast("long").alias("shared"), F.round(F.lit(mash_distance(0, size, k)), 9).alias("d"))
    return found.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")).cast("long")).where(F.col("rank") <= most)
