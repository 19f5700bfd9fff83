"""Toxicity: a lexicon trie under Levenshtein automata, and scores of the hits' context.

Labelled rows give a weighted lexicon. All its terms stand in one trie; a deterministic automaton, built as words
ask for it, runs over the sets of (trie node, errors) that the Levenshtein automata of all terms can be in, so a
misspelled term is caught in one pass over its letters. Each hit is scored in its window of words: other hits
nearby strengthen it, quotation marks around it or a reporting verb before it weaken it. A logistic model of these
scores, fitted on hits from lexicons learnt without the row at hand, gives the probability.

Bounds: the lexicon and the model are fitted on at most MOST_LABELLED documents of each label, those of the least hash
of doc_id; so the lexicon is bounded too. Near copies are no evidence of their own, so of sample documents with one label that share
the least shingle hash in any of COPY_KEYS orders only the first counts: else each word of a text with thousands of copies
would pass for a term. It takes every word of theirs that passes one test: the word's share of
label 1 is more than it would be if the word were LIFT times as frequent in label 1 as in label 0 (just as frequent, by
default; Chernoff's bound of the binomial tail), at an expected share of ALPHA of wrong words among those taken (the procedure of Benjamini and
Hochberg over all words of the sample, in steps of 0.01 of the logarithm). Scoring reads every whole text.

Cases: null text counts as empty; texts without hits share one low score; texts of any length are read whole; repeated
rows are each scored, but a document counts once in the fit (of several texts of one doc_id the least), and once with
each label it has; without labels of both kinds the lexicon is empty and every score is the share of label 1 (0 without
labels); null labels are left out; of terms that fit a word equally well the heavier counts, then the first in order;
all columns of the rows stay, and those named n_hits or like the output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cladespark.llm.common import Remembered, held, held_out, materialized, table, whole, with_made
from cladespark.llm.sketch import SEEDS, Shingler, mixed

MOST_LABELLED = 10_000
#: The test of a term, as above.
LIFT, ALPHA = 1.0, 0.1
WINDOW = 10
#: A quoted or reported hit counts so much.
QUOTED = 0.3
#: Orders of the shingles by which near copies of the sample are known: at a similarity of 0.8 one of 4 agrees with 0.998.
COPY_KEYS = 4
REPORTING = frozenset("said says wrote called quoted quote reported accused word term phrase".split())
EDGES = " .,;:!?|#%&$*\"'()[]{}<>…«»“”„‘’-_~`"
_quote = re.compile('["“”«»„]')
FEATURES = 8


def allowed(term: str) -> int:
    """Errors that still count as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class FuzzyLexicon:
    """word -> (term, errors) of the best term within its allowed errors, or None."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # errors that any term below a node allows
        for term in sorted(weights):
            node = 0
            for letter in term:
                self.most[node] = max(self.most[node], allowed(term))
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][letter]
            self.most[node] = max(self.most[node], allowed(term))
            self.term[node] = term
        self._restart()

    def _restart(self) -> None:
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.numbers: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self._number({(0, 0)})

    def _number(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these pairs and of those that skip letters of the term."""
        todo, best = [*pairs], {}
        while todo:
            node, errors = todo.pop()
            if errors > self.most[node] or best.get(node, 9) <= errors:
                continue
            best[node] = errors
            todo += [(child, errors + 1) for child in self.children[node].values()]
        state = frozenset(best.items())
        if (number := self.numbers.get(state)) is None:
            number = self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            ends = [(e, -self.weights[t], t) for n, e in best.items() if (t := self.term[n]) is not None and e <= allowed(t)]
            self.accepts.append((min(ends)[2], min(ends)[0]) if ends else None)
        return number

    def _move(self, state: int, letter: str) -> int:
        pairs = set()
        for node, errors in self.sets[state]:
            if letter in self.children[node]:
                pairs.add((self.children[node][letter], errors))
            pairs.add((node, errors + 1))
            pairs.update((child, errors + 1) for child in self.children[node].values())
        number = self.moves[state][letter] = self._number(pairs)
        return number

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > 50_000:
            self._restart()
        state = 0
        for letter in word:
            nxt = self.moves[state].get(letter)
            state = self._move(state, letter) if nxt is None else nxt
            if not self.sets[state]:
                return None
        return self.accepts[state]


class Scorer:
    """Text -> features of its hits."""

    def __init__(self, weights: dict[str, float]):
        self.lexicon = FuzzyLexicon(weights)
        self.known = Remembered(lambda word: self.lexicon.match(word.strip(EDGES)), 200_000)

    def hits(self, text: str) -> list[tuple[int, str, int, bool]]:
        """(word position, term, errors, quoted or reported) of each hit."""
        low = text.lower()
        words, known = low.split(), self.known
        found = {w: m for w in set(words) if (m := known[w]) is not None}
        if not found:
            return []
        marks = [m.start() for m in _quote.finditer(low)]
        out, at = [], 0
        for k, w in enumerate(words):
            if w in found:
                inside = False
                if marks:
                    middle = low.index(w, at) + len(w) - len(w.lstrip(EDGES))
                    before = bisect.bisect_left(marks, middle)
                    inside = before % 2 == 1 and before < len(marks)
                reported = any(x.strip(EDGES) in REPORTING for x in words[max(0, k - 3) : k])
                out.append((k, *found[w], inside or reported))
            if marks:
                at = low.index(w, at) + len(w)
        return out

    def features(self, text: str) -> tuple[list[float], int]:
        hits = self.hits(text)
        if not hits:
            return [0.0] * FEATURES, 0
        weight = self.lexicon.weights
        value = [weight[t] * (1.0 if e == 0 else 0.5) * (QUOTED if q else 1.0) for _, t, e, q in hits]
        places = [h[0] for h in hits]
        total = np.concatenate([[0.0], np.cumsum(value)])
        windows = [total[bisect.bisect_right(places, p + WINDOW)] - total[bisect.bisect_left(places, p - WINDOW)] for p in places]
        exact = [weight[t] for _, t, e, _ in hits if e == 0]
        rough = [weight[t] for _, t, e, _ in hits if e]
        n = max(1, len(text.split()))
        return [
            1.0,
            float(np.log1p(sum(exact))),
            float(np.log1p(sum(rough))),
            float(np.log1p(len({h[1] for h in hits if h[2] == 0}))),
            float(np.log1p(max(windows))),
            sum(h[3] for h in hits) / len(hits),
            float(np.log1p(100 * sum(value) / n)),
            max(exact, default=0.0),
        ], len(hits)


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]  # of the features, and the constant


def scorer(terms: tuple[tuple[str, float], ...]) -> Scorer:
    return held(("scorer", terms), lambda: Scorer(dict(terms)))


def with_features(rows: DataFrame, terms: tuple[tuple[str, float], ...], text: str = "text", out: str = "features") -> DataFrame:
    """rows with the column out (array<double>) and n_hits."""

    def maker():
        own = scorer(terms)
        return lambda texts: [*zip(*[own.features(t or "") for t in texts])]

    return with_made(rows, text, f"{out} array<double>, n_hits long", maker)


def learn_terms(rows: DataFrame, lift: float = LIFT, alpha: float = ALPHA) -> tuple[tuple[str, float], ...]:
    """The words (of rows: text, y) that stand out in label 1, with their smoothed log-odds."""

    @pandas_udf("array<string>")
    def vocabulary(batch: pd.Series) -> pd.Series:
        return pd.Series([list({w.strip(EDGES) for w in (t or "").lower().split()} - {""}) for t in batch], dtype=object)

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return ()
    p, q = F.col("p"), F.col("q")
    per = rows.select(F.explode(vocabulary("text")).alias("word"), "y").groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    per = materialized(per, "toxic-words")
    null = lift * ones / (lift * ones + zeros)
    log = lambda x: F.log(F.greatest(x, F.lit(1e-300)))  # noqa: E731  0 log 0 is 0
    evidence = p * log(p / (p + q) / null) + q * log(q / (p + q) / (1 - null))
    odds = F.log((p + 0.5) / (ones + 1.0)) - F.log((q + 0.5) / (zeros + 1.0))
    told = per.where(p / (p + q) > null).select("word", F.round(odds, 6).alias("odds"), F.floor(100 * evidence).cast("long").alias("step"))
    words, taken, least = per.count(), 0, None
    # from the strongest step down: the weakest one at which so many words are taken that ALPHA of them may be wrong
    for r in told.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).toLocalIterator():
        taken += r["n"]
        if r["step"] / 100 >= np.log(words / (alpha * taken)):
            least = r["step"]
    if least is None:
        return ()
    return tuple(sorted((r["word"], r["odds"]) for r in told.where(F.col("step") >= least).select("word", "odds").collect()))


def without_copies(sample: DataFrame) -> DataFrame:
    """sample (bounded: doc_id, y, text) without documents that an earlier one with their label is a near copy of."""

    def maker():
        shingles, seeds = Shingler(), SEEDS[:COPY_KEYS]
        return lambda texts: [[[int(mixed(own ^ s).min()) >> 1 for s in seeds] if len(own := shingles(t)) else [] for t in texts]]

    keyed = materialized(with_made(sample.select("doc_id", "y", "text"), "text", "keys array<long>", maker).select("doc_id", "y", F.posexplode("keys").alias("turn", "key")), "toxic-copies")
    first = keyed.groupBy("y", "turn", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    gone = keyed.join(first, ["y", "turn", "key"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "y").distinct()
    return sample.join(gone, ["doc_id", "y"], "left_anti")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """docs: doc_id, text; labels: doc_id, y (0 or 1), of rows that may be learnt from."""
    labels = labels.where(F.col("y").isNotNull())
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = 1.0 if sizes.get(1) else 0.0
        return Model((), (0.0,) * FEATURES + (30.0 if share else -30.0,))
    once = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "y").distinct().withColumn("turn", F.xxhash64("doc_id"))
    # at most 2 * most small rows: safe to broadcast
    chosen = [once.where(F.col("y") == y).orderBy("turn", "doc_id").limit(most) for y in (0, 1)]
    chosen = materialized(chosen[0].union(chosen[1]), "toxic-labels").select(F.col("doc_id").alias("__id"), "y")
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = without_copies(materialized(sample, "toxic-labelled"))
    sample = materialized(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))).repartition(16), "toxic-sample")
    parts = []
    for half in (0, 1):
        terms = learn_terms(sample.where(F.col("half") != half))
        parts += with_features(sample.where(F.col("half") == half), terms).select("features", "y").collect()
    if not parts:
        return Model((), (0.0,) * FEATURES + (-30.0,))
    x, y = np.array([p["features"] for p in parts]), np.array([p["y"] for p in parts], float)
    w = logistic(x, y)
    # the sample thins out the two labels differently
    w[-1] += np.log(min(1, most / sizes[0]) / min(1, most / sizes[1]))
    return Model(learn_terms(sample), tuple(map(float, w)))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with n_hits and the column out, the probability of label 1."""
    x = with_features(docs.select(whole(docs).alias("doc")), model.terms, f"doc.{text}")
    line = F.lit(model.weights[-1])
    for k, w in enumerate(model.weights[:-1]):
        line = line + F.col("features")[k] * F.lit(w)
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_hits", out)]
    return x.select(*kept, "n_hits", (1 / (1 + F.exp(-line))).alias(out))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("y"))
    got = with_score(docs, fit(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
