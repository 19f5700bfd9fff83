"""Distances of aligned sequences under six substitution models, and operations on distance matrices.

All models follow from the joint counts of (base, base) over the sites of a pair. Pairs of small families are made by a
join, and their counts taken for whole Arrow batches at once; larger families are dealt to (block, block) tasks, where
the counts of all pairs of two blocks are one matrix product. Arguments of logarithms that are not positive give NaN or
infinity, as in IEEE arithmetic, not NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cladespark.sources.shared import materialized

#: (rows a, rows b) -> matrix of distances.
Metric = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
MODELS = ("p", "jc", "tn", "k2p", "tamura", "jinnei")
_codes = np.full(256, 4, np.uint8)
_codes[0] = 5
_codes[[ord(c) for c in "ACGTU"]] = [0, 1, 2, 3, 3]


#: Sequences of a block, and members up to which a family is one join.
BLOCK, FAMILY = 256, 64


def coded(alignments: Iterable[str | None]) -> np.ndarray:
    """One row of codes per sequence (A0 C1 G2 T3, else 4); 5 where a sequence is shorter than the longest."""
    texts = [(t or "").encode("ascii", "replace") for t in alignments]
    width = max(map(len, texts), default=0)
    return _codes[np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)]


def paired_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of n pairs -> n rows of 25 counts: at 5 x + y, how many sites have code x in the first and y in the second sequence. Sites
    beyond the end of either are no sites."""
    n, width = len(a), min(a.shape[1], b.shape[1])
    x, y = a[:, :width].astype(np.int64), b[:, :width]
    cells = np.where((x < 5) & (y < 5), 5 * x + y, 25) + 26 * np.arange(n)[:, None]
    return np.bincount(cells.ravel(), minlength=26 * n).reshape(n, 26)[:, :25]


def joint_counts(a: str, b: str) -> np.ndarray:
    return paired_counts(coded([a]), coded([b]))[0]


def crossed_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of n and m sequences -> the counts of all pairs, (n, m, 25), as products of their indicator matrices."""
    width = min(a.shape[1], b.shape[1])
    kind = np.float32 if width < 1 << 24 else np.float64
    x, y = (np.stack([v[:, :width] == c for c in range(5)], 1).astype(kind).reshape(5 * len(v), width) for v in (a, b))
    return (x @ y.T).reshape(len(a), 5, len(b), 5).transpose(0, 2, 1, 3).reshape(len(a), len(b), 25)


class Shares:
    """The matches and sites of sequences with a list of others, all that the models p and jc need: products of indicators of the four bases and of
    gaps, a fifth of the work of all counts. Their results are the same numbers."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.made = codes, {}

    def _of(self, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, kind = codes[:, :width], np.float32 if width < 1 << 24 else np.float64
        return np.stack([codes == c for c in range(4)], 1).astype(kind).reshape(len(codes), 4 * width), (codes == 4).astype(kind), (codes < 5).astype(kind)

    def distances(self, a: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray]:
        """Settled, as of all counts, and where the model defines one."""
        width = min(a.shape[1], self.codes.shape[1])
        if width not in self.made:
            self.made = {width: self._of(self.codes, width)}
        (bases, gaps, real), (other, others_gaps, others_real) = self._of(a, width), self.made[width]
        match = (bases @ other.T).astype(float)
        whole = real.all() and others_real.all()
        sites = (np.full(match.shape, float(width)) if whole else (real @ others_real.T).astype(float)) - (gaps @ others_gaps.T).astype(float)
        with np.errstate(all="ignore"):
            d = 1 - match / sites
            d = d if model == "p" else -0.75 * np.log(1 - d / 0.75)
        defined, top = np.isfinite(d), SHARE if model == "p" else SATURATED
        if defined.all():
            return np.minimum(d, top), defined
        both = (real - gaps) @ (others_real - others_gaps).T
        return np.where(defined, np.minimum(np.where(defined, d, 0.0), top), np.where((match == both) & (both > 0), 0.0, top)), defined


#: Substitutions per site that stand for all distances that are larger, infinite or undefined when a tree is built: Jukes-Cantor
#: reaches them 0.001 below the share of differing sites (0.75) from which it is undefined. Shares of sites end at 1.
SATURATED, SHARE = 5.0, 1.0


def settled(counts: np.ndarray, d: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances that trees can be built of, and where the model defines one. Sequences that differ at no common site are 0 apart in every
    form of a model; other undefined distances, and those beyond saturation, are SATURATED (SHARE for the share of sites)."""
    n = counts.reshape(-1, 5, 5)
    defined = np.isfinite(d)
    sites = n[:, :4, :4].sum(axis=(1, 2))
    same = (np.trace(n[:, :4, :4], axis1=1, axis2=2) == sites) & (sites > 0)
    top = SHARE if model == "p" else SATURATED
    return np.where(defined, np.minimum(np.where(defined, d, 0.0), top), np.where(same, 0.0, top)), defined


def alignment_metric(model: str = "jc", compat: bool = False, aln: str = "seq") -> Metric:
    """The distances of all sequences of one table to all of another, settled, a bounded block of pairs at a time. Its attribute `flagged` gives
    them with where they are defined."""

    def flagged(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, y = coded(a[aln]), coded(b[aln])
        out, defined = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), bool)
        if model in ("p", "jc"):
            for j in range(0, len(y), 512):
                others = Shares(y[j : j + 512])
                for k in range(0, len(x), 128):
                    here = slice(k, k + 128), slice(j, j + 512)
                    out[here], defined[here] = others.distances(x[k : k + 128], model)
            return out, defined
        for k in range(0, len(x), 64):
            for j in range(0, len(y), 512):
                counts = crossed_counts(x[k : k + 64], y[j : j + 512])
                flat, here = counts.reshape(-1, 25), (slice(k, k + 64), slice(j, j + 512))
                made = settled(flat, distances(flat, model, compat), model)
                out[here], defined[here] = (v.reshape(counts.shape[:2]) for v in made)
        return out, defined

    def metric(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return flagged(a, b)[0]

    metric.flagged = flagged
    return metric


def distances(counts: np.ndarray, model: str, compat: bool = False) -> np.ndarray:
    """counts: one row of joint counts per pair. compat changes tn and tamura only: True takes them as the matched engine writes
    them (other than the textbooks do); False gives Tajima-Nei 1984 and Tamura 1992, with 0 for identical sequences."""
    n = counts.reshape(-1, 5, 5).astype(float)
    inner = n[:, :4, :4]
    match, total = np.trace(inner, axis1=1, axis2=2), inner.sum(axis=(1, 2))
    with np.errstate(all="ignore"):
        if model in ("p", "jc"):
            # a base against a gap is a mismatch; a gap against a gap is no site
            p = 1 - match / (n.sum(axis=(1, 2)) - n[:, 4, 4])
            return p if model == "p" else -0.75 * np.log(1 - p / 0.75)
        if model == "tn":
            f = (inner.sum(axis=2) + inner.sum(axis=1)) / (2 * total[:, None])
            d = (total - match) / total
            both = inner + inner.transpose(0, 2, 1)
            if compat:
                h = 0.5 * sum(both[:, x, y] * f[:, x] * f[:, y] for x, y in ((0, 2), (0, 3), (1, 2), (1, 3)))
                b = 0.5 * (1 - f[:, 0] ** 2 - f[:, 2] ** 2 + d * d / h)
                return -b * np.log(1 - d / b)
            pairs = [(x, y) for x in range(4) for y in range(x + 1, 4)]
            h = sum(np.where(both[:, x, y] > 0, (both[:, x, y] / total) ** 2 / (2 * f[:, x] * f[:, y]), 0.0) for x, y in pairs)
            b = 0.5 * (1 - (f * f).sum(axis=1) + d * d / h)
            return np.where(d == 0, 0.0, -b * np.log(1 - d / b))
        p = (inner[:, 0, 2] + inner[:, 2, 0] + inner[:, 1, 3] + inner[:, 3, 1]) / total
        q = 1 - match / total - p
        if model == "k2p":
            return -0.5 * np.log((1 - 2 * p - q) * np.sqrt(1 - 2 * q))
        if model == "jinnei":
            return 0.5 * (1 / (1 - 2 * p - q) + 0.5 / (1 - 2 * q) - 1.5)
        if model == "tamura":
            sites = inner * (1 - np.eye(4)) if compat else inner
            g1, g2 = sites[:, 1:3, :].sum(axis=(1, 2)) / total, sites[:, :, 1:3].sum(axis=(1, 2)) / total
            c = g1 + g2 - 2 * g1 * g2
            out = -c * np.log(1 - p / c - q) - 0.5 * (1 - c) * np.log(1 - 2 * q)
            return out if compat else np.where((p == 0) & (np.abs(q) < 1e-15), 0.0, out)
    raise ValueError(f"no such model: {model}")


def _distance(model: str, compat: bool):
    @pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances(paired_counts(coded(a), coded(b)), model, compat) if len(a) else [], dtype=float)

    return distance


def candidate_distances(pairs: DataFrame, alignments: DataFrame, model: str = "jc", compat: bool = False) -> DataFrame:
    """pairs: i, j (ids); alignments: ord, aln. The given pairs only, with their distance: i, j, d."""
    a = alignments.select(F.col("ord").alias("i"), F.col("aln").alias("x"))
    b = alignments.select(F.col("ord").alias("j"), F.col("aln").alias("y"))
    return pairs.select("i", "j").join(a, "i").join(b, "j").select("i", "j", _distance(model, compat)("x", "y").alias("d"))


def pair_distances(alignments: DataFrame, group: str, model: str, compat: bool = False, family: int = FAMILY, block: int = BLOCK) -> DataFrame:
    """alignments: a group column, ord, aln. All pairs i < j inside each group with their distance: group, i, j, d.

    Groups of up to `family` members are joined with themselves; each larger one is cut into blocks of about `block` members by a
    hash of ord, and each pair of blocks is a task of its own, so no task holds more than two blocks."""
    kind = {c: alignments.schema[c].dataType.simpleString() for c in (group, "ord")}
    large = materialized(alignments.groupBy(group).count().where(F.col("count") > family).select(F.col(group).alias("__g"), F.ceil(F.col("count") / block).cast("int").alias("__n")), "large-families")
    few, many = alignments, None
    if large.head(1):
        few = alignments.join(large, F.col(group).eqNullSafe(F.col("__g")), "left_anti")
        many = alignments.join(large, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__own", F.pmod(F.xxhash64("ord"), F.col("__n")).cast("int"))
    a = few.select(group, F.col("ord").alias("i"), F.col("aln").alias("x"))
    b = few.select(F.col(group).alias("__h"), F.col("ord").alias("j"), F.col("aln").alias("y"))
    out = a.join(b, F.col(group).eqNullSafe(F.col("__h")) & (F.col("i") < F.col("j"))).select(group, "i", "j", _distance(model, compat)("x", "y").alias("d"))
    if many is None:
        return out
    metric = alignment_metric(model, compat, "aln")
    # a member goes to the tasks of its block with every block: (least, greatest) of the two numbers
    dealt = many.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    dealt = dealt.select(group, "ord", "aln", "__own", F.least("__own", "__other").alias("__a"), F.greatest("__own", "__other").alias("__b"))

    def blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[rows["__own"] == k].reset_index(drop=True) for k in key[1:])
        d, defined = metric.flagged(x, y)
        d[~defined] = np.nan
        p, q = np.triu_indices(len(x), 1) if key[1] == key[2] else (v.ravel() for v in np.indices(d.shape))
        i, j = x["ord"].to_numpy()[p], y["ord"].to_numpy()[q]
        return pd.DataFrame({group: key[0], "i": np.minimum(i, j), "j": np.maximum(i, j), "d": d[p, q]})

    made = dealt.groupBy(group, "__a", "__b").applyInPandas(blocks, f"{group} {kind[group]}, i {kind['ord']}, j {kind['ord']}, d double")
    return out.unionByName(made)


def mirrored(dist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lower or upper triangle (keys, i, j, d) -> both triangles and a zero diagonal."""
    keys = keys or []
    swapped = dist.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "d")
    both = dist.select(*keys, "i", "j", "d").unionByName(swapped)
    return both.unionByName(both.select(*keys, "i").distinct().select(*keys, "i", F.col("i").alias("j"), F.lit(0.0).alias("d")))


def row_sums(full: DataFrame, keys: list[str]) -> DataFrame:
    return full.where("i <> j").groupBy(*keys, "i").agg(F.sum("d").alias("u"))


def next_join(full: DataFrame, keys: list[str]) -> DataFrame:
    """The pair that neighbor joining joins first in each group: keys, i, j, q, blx, bly. Ties go to the smallest (i, j)."""
    u = row_sums(full, keys)
    n = u.groupBy(*keys).agg(F.count("*").alias("n"))
    x = full.where("i < j").join(u.withColumnRenamed("u", "ui"), [*keys, "i"])
    x = x.join(u.select(*keys, F.col("i").alias("j"), F.col("u").alias("uj")), [*keys, "j"]).join(n, keys).where("n > 2")
    q = F.round(F.col("d") - F.col("ui") / (F.col("n") - 2) - F.col("uj") / (F.col("n") - 2), 9)
    best = x.withColumn("q", q).groupBy(*keys).agg(F.min(F.struct("q", "i", "j", "d", "ui", "uj", "n")).alias("b")).select(*keys, "b.*")
    blx = (F.col("d") + (F.col("ui") - F.col("uj")) / (F.col("n") - 2)) / 2
    bly = F.col("d") - blx
    # a negative branch gives its length to the other one
    x0 = F.when(blx < 0, 0.0).otherwise(blx)
    y0 = F.when(blx < 0, bly + blx).otherwise(bly)
    return best.select(*keys, "i", "j", "q", F.when(y0 < 0, x0 + y0).otherwise(x0).alias("blx"), F.when(y0 < 0, 0.0).otherwise(y0).alias("bly"))
