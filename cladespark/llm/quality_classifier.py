"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over standardised statistics of a text. The ridge
weights solve normal equations that each partition sums over its own labelled rows; only sums meet. A fold that
the weights have not seen gives, in fixed bins, the label shares that pool-adjacent-violators makes monotone.

Cases: null text counts as empty and is scored like any text; texts of any length are read whole; repeated rows, also of
labels, each count; without labels every score is 0.5, with labels of one kind it is that label; null labels are left
out; equal statistics have equal scores, in any order of rows; other columns of the rows stay, and one with an output's
name is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cladespark.llm.common import fold, held_out, materialized, table, with_made

FEATURES = 192
RIDGE = 1e-2
SEED = 20240
#: Bins of the raw score, from -0.5 to 1.5, in which calibration counts labels.
BINS = 500
#: So many partial sums at most are added up in one task; the driver gets no more than so many.
FAN_IN = 16
STATS = 18


def statistics(text: str) -> list[float]:
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    times = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = [*zip(words, words[1:], words[2:])]
    stops = text.count(".") + text.count("!") + text.count("?")
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        sum(map(text.count, "#*$%&|<>")) / chars,
        text.count("!") / n,
        text.count("|") / n,
        sum(map(text.count, ".,;:?")) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.islower, words)) / n,
        len(times) / n,
        float(np.log1p(n / max(1, len(times)))),
        max(times.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(windows)) / max(1, len(windows)),
        len(lines) / n,
        stops / n,
    ]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    return with_made(docs, text, f"{out} array<double>", lambda: lambda texts: [[statistics(t or "") for t in texts]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # middles of bins
    shares: np.ndarray  # calibrated share of label 1 there

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # a millionth of the raw score keeps the order inside steps of equal share
        return (1 - 1e-6) * np.interp(raw, self.steps, self.shares) + 1e-6 / (1 + np.exp(-4 * raw + 2))


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features whose products approximate the Gaussian kernel of standardised statistics, and a constant."""
    random = np.random.default_rng(SEED)
    spread = random.standard_normal((stats.shape[1], FEATURES)) / np.sqrt(stats.shape[1])
    shift = random.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ spread + shift), np.ones((len(stats), 1))])


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows (stats, y): one matrix from each partition, added up FAN_IN at a time until so many are left."""
    size = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(np.stack(batch["stats"].to_numpy()), mean, scale) if len(batch) else np.zeros((0, size))
            total += z.T @ np.hstack([z, batch["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def added(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [key[0]], "total": [sum(np.frombuffer(x) for x in batch["total"]).tobytes()]})

    parts = materialized(rows.mapInPandas(sums, "g int, total binary"), "sums")
    left = (parts.agg(F.max("g")).first()[0] or 0) + 1
    while left > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("g") / FAN_IN).cast("int").alias("g")).applyInPandas(added, "g int, total binary")
        left = -(-left // FAN_IN)
    parts = parts.collect()
    total = sum((np.frombuffer(p.total) for p in parts), np.zeros(size * (size + 1))).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values, by pooling neighbours that violate the order."""
    pools: list[list[float]] = []  # value, weight, length
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def fit(labelled: DataFrame) -> Model:
    """labelled: stats, y (0 or 1), part (rows of part 4 calibrate, the others give the weights)."""
    first = labelled.where("part != 4")
    got = first.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *[f(F.col("stats")[k]).alias(f"{f.__name__}{k}") for k in range(STATS) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = (np.array([got[f"{f}{k}"] or 0.0 for k in range(STATS)]) for f in ("avg", "stddev_pop"))
    scale[scale < 1e-9] = 1.0
    zero, flat = np.zeros(FEATURES + 1), np.array([0.0])
    if not got.n or got.ones in (0, got.n):
        return Model(mean, scale, zero, flat, np.array([got.ones / got.n if got.n else 0.5]))
    a, b = normal_equations(first, mean, scale)
    model = Model(mean, scale, np.linalg.solve(a + RIDGE * np.eye(len(a)), b), flat, flat)

    @pandas_udf("int")
    def bin_of(stats: pd.Series) -> pd.Series:
        raw = model.raw(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0)
        return pd.Series(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int))

    counts = labelled.where("part = 4").groupBy(bin_of("stats").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    if not counts:
        return Model(mean, scale, model.weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    bins, n, ones = np.array(sorted((r["bin"], r["n"], r["ones"]) for r in counts), float).T
    # half a row of the overall share in each bin keeps scores off 0 and 1
    shares = isotonic((ones + 0.5 * ones.sum() / n.sum()) / (n + 0.5), n + 0.5)
    return Model(mean, scale, model.weights, (bins + 0.5) / BINS * 2 - 0.5, shares)


def with_score(rows: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """rows with the column out, from their column stats."""

    @pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    return rows.withColumn(out, score("stats"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "statistics")
    labels = table(spark, sf_dir, "labels").where(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("y"))
    model = fit(materialized(rows.join(labels, "doc_id").select("stats", "y", fold().alias("part")), "labelled"))
    return with_score(rows, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
