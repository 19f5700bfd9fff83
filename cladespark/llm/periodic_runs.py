"""Periodic runs of words: online dyadic square catching.

Words are appended in portions of any size. On level k a block is one of the stretches of m = 2 ** k words that start at a multiple
of m; when it is complete, it becomes a catcher for periods from m to 2 m - 1: each suffix of m words that starts in the
block after it is compared with it, by names that stand for stretches of m words (a name of 2 m words is made of two of m).
A suffix equal to its catcher is a square's beginning: the words of both, one period apart, are compared to the left as
far as they agree, and to the right as words come. Where they agree over a period and more they are a square; squares of one
period that overlap are one run. A run of period q holds every catch it needs: of its 4 q words or more, some block
of the level with m <= q < 2 m begins within its first m words.

What repeats inside a run of a smaller period is no new run: by the periodicity lemma its period is a multiple of the smaller one.
So a text of one word only has n catches on the first level and nothing to compare on the others, and the work is
n log n for any text. A name is 64 bits of mixed word numbers; what it catches is compared word by word before it counts.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import table, with_made, words_of
from cladespark.llm.sketch import FACTORS, mixed

#: A run has so many periods and so many words at least.
TIMES, LEAST = 4, 6
#: Words that are appended at once.
PORTION = 1 << 15


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first elements of two arrays of one length are equal."""
    at, step, n = 0, 64, len(x)
    while at < n:
        other = x[at : at + step] != y[at : at + step]
        k = int(other.argmax())
        if other[k]:
            return at + k
        at, step = at + step, 4 * step
    return n


class SquareCatcher:
    """append() takes word numbers; runs() gives (start, length, period) of all runs so far, by start and period."""

    def __init__(self, times: int = TIMES, least: int = LEAST):
        self.times, self.least = times, least
        self.text = np.zeros(0, np.int64)
        self.names: list[np.ndarray] = []  # by level: a name for each start
        self.open: dict[int, tuple[int, int]] = {}  # period -> (start, where its comparison goes on)
        self.squares: list[tuple[int, int, int]] = []  # (start, end, period): agreement that has ended, of two periods at least

    def append(self, words: np.ndarray) -> None:
        self.text = np.concatenate([self.text, words]) if len(self.text) else np.asarray(words, np.int64)
        n = len(self.text)
        waiting, self.open = self.open, {}
        for q, (start, at) in waiting.items():
            self._follow(q, start, at)
        level, m = 0, 1
        while self.times * m <= n:
            hits = self._compared(level, m, n)
            if len(hits):
                self._caught(hits, m)
            level, m = level + 1, 2 * m

    def _compared(self, level: int, m: int, n: int) -> np.ndarray:
        """Starts of the new suffixes of m words that equal the block before their own."""
        if level == len(self.names):
            self.names.append(np.zeros(0, np.uint64))
        old = len(self.names[level])
        if level == 0:
            new = mixed(self.text[old:].view(np.uint64) + FACTORS[0])
        else:
            below, half = self.names[level - 1], m // 2
            new = mixed(below[old : n - m + 1] * FACTORS[1] + below[old + half : n - m + 1 + half] * FACTORS[2])
        names = self.names[level] = np.concatenate([self.names[level], new]) if old else new
        starts = np.arange(max(old, m), n - m + 1)
        return starts[names[starts] == names[(starts & -m) - m]]

    def _known(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all squares of periods below m, sorted, and the farthest end of those up to each."""
        every = sorted([(a, b) for a, b, q in self.squares if q < m] + [(a, at + q) for q, (a, at) in self.open.items() if q < m and at - a >= q])
        bounds = np.array(every, np.int64).reshape(-1, 2)
        return bounds[:, 0], np.maximum.accumulate(bounds[:, 1])

    def _caught(self, hits: np.ndarray, m: int) -> None:
        first = (hits & -m) - m
        starts, ends = self._known(m)
        if len(starts):
            at = np.searchsorted(starts, first, "right") - 1
            inside = (at >= 0) & (ends[at] >= hits + m)
            hits, first = hits[~inside], first[~inside]
        periods = hits - first
        order = np.lexsort((first, periods))
        periods, first = periods[order], first[order]
        k = 0
        while k < len(first):
            q, s = int(periods[k]), int(first[k])
            if q in self.open and self.open[q][0] <= s:
                end = len(self.text)  # all of this period from here on is one comparison
            else:
                left = agreeing(self.text[:s][::-1], self.text[q : s + q][::-1])
                end = self._follow(q, s - left, s)
            # other catches of the same agreement are behind it
            k += max(1, int(np.searchsorted(first[k:][periods[k:] == q], end - m + 1)))

    def _follow(self, q: int, start: int, at: int) -> int:
        """Compares on from `at`; gives where the agreement ends so far."""
        end = at + agreeing(self.text[at : len(self.text) - q], self.text[at + q :])
        if end + q == len(self.text):
            self.open[q] = (start, end)
        elif end - start >= q:
            self.squares.append((start, end + q, q))
        return end

    def runs(self) -> list[tuple[int, int, int]]:
        every = {*self.squares, *((a, at + q, q) for q, (a, at) in self.open.items())}
        found: dict[tuple[int, int], int] = {}
        for a, b, q in every:
            if b - a >= max(self.least, self.times * q):
                found[a, b] = min(q, found.get((a, b), q))
        return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(words: list, times: int = TIMES, least: int = LEAST, portion: int = PORTION) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of any list of words, by start, then period."""
    if len(words) < least:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    catcher = SquareCatcher(times, least)
    for k in range(0, len(ids), portion):
        catcher.append(ids[k : k + portion])
    return catcher.runs()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [*compress(words, (np.cumsum(change[:-1]) == 0).tolist())]


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (by start, then period) and collapsed (the text with one period of each run, words joined by one space).

    Cases: null, empty and blank texts have no words and no runs, and collapse to the empty text; texts of any length are taken
    whole, in portions; equal rows give equal results; an empty table gives an empty one; other columns stay, but for
    columns of these three names, which are replaced."""

    def maker():
        def one(text: str | None) -> tuple:
            words = words_of(text)
            runs = runs_of(words)
            return len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")

        return lambda texts: [*zip(*map(one, texts))]

    return with_made(docs, text, RUNS, maker)


def planted(words: list, doc_id: int | None) -> list:
    """The words of op13's contract: in one document of ten the words repeat from some word on. A null doc_id counts as the empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", "text").alias("doc"))

    def maker():
        def one(row: dict) -> tuple:
            words = planted(words_of(row["text"]), row["doc_id"])
            runs = runs_of(words)
            start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
            digests = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(collapsed(words, runs)))]
            return len(runs), start, length, period, None if start is None else 1000 * length // period, *digests

        return lambda rows: [*zip(*map(one, rows))]

    return with_made(docs, "doc", COLUMNS, maker).select("doc.doc_id", *[c.split()[0] for c in COLUMNS.split(", ")])


def _oracle() -> str:
    """Stretches of 2 ** k words that occur again one to two of their lengths later, in the next block, name a document's possible
    periods; of each, all words that equal the word one period later are grouped into islands."""
    levels = 14  # periods below 2 ** levels: texts of up to 65,536 words
    steps = ["w0 AS (SELECT *, hash(word) AS h FROM words)"]
    for k in range(1, levels):
        half = 1 << (k - 1)
        steps.append(f"w{k} AS (SELECT doc, i, word, n, hash(h, lead(h, {half}) OVER (PARTITION BY doc ORDER BY i)) AS h FROM w{k - 1} QUALIFY i + {2 * half} <= n)")
    found = " UNION ".join(f"SELECT x.doc, y.i - x.i AS q FROM w{k} x JOIN w{k} y ON x.doc = y.doc AND x.h = y.h AND x.i % {1 << k} = 0 AND x.i // {1 << k} + 1 = y.i // {1 << k} WHERE 4 * (y.i - x.i) <= x.n" for k in range(levels))
    return f"""WITH given AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1), lambda k: [ascii(s[k]), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS h, len(w) AS n FROM given),
places AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS d FROM crc),
words AS (SELECT doc, i, n, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // d)] ELSE w[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM places)),
{", ".join(steps)},
periods AS ({found}),
same AS (SELECT p.doc, p.q, x.i FROM periods p JOIN words x ON x.doc = p.doc JOIN words y ON y.doc = p.doc AND y.i = x.i + p.q AND y.word = x.word),
islands AS (SELECT doc, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc, q ORDER BY i) AS g FROM same) GROUP BY doc, q, g HAVING count(*) >= 3 * q AND count(*) + q >= 6),
runs AS (SELECT doc, start, length, min(q) AS period FROM islands GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY doc),
gone AS (SELECT DISTINCT doc, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (doc, i) GROUP BY doc)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(l.s, '')) AS runs_sha256, sha256(coalesce(k.s, '')) AS collapsed_sha256
FROM given g LEFT JOIN best b USING (doc) LEFT JOIN listed l USING (doc) LEFT JOIN kept k USING (doc)"""


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": _oracle()}
