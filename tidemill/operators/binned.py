"""Rows of equal bins added up, and forests that are grown on them.

Trees split a feature at no more than ``bins - 1`` places, so rows that fall into
the same bins and have the same label are one row with a weight. Their number
does not grow with the rows once all combinations that occur have occurred.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums are kept by every worker that grows trees; more of them are left to MLlib, which spreads rows.
MOST_CELLS = 2_000_000


def bin_values(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """At most so many values of each column that stand for all: every value where there are no more, else quantiles."""
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= 2 * bins]
    sets = df.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    found = {c: sorted(set(sets[c])) for c in few}
    many = [c for c in columns if len(found.get(c, [0.0] * (bins + 1))) > bins]
    if many:
        shares = [(2 * i + 1) / (2 * bins) for i in range(bins)]
        found |= {c: sorted(set(q)) for c, q in zip(many, df.approxQuantile(many, shares, 1 / (8 * bins)))}
    return {c: found[c] for c in columns}


def bin_number(column: Column, values: list[float]) -> Column:
    """The place of the value that stands for a row's: the nearest, the lower of two, as a split half way decides."""
    cuts = [(a + b) / 2 for a, b in pairwise(values)]

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column <= cuts[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, max(0, len(values) - 1)).cast("int")


def cells(df: DataFrame, values: dict[str, list[float]], by: list[str], weight: Column) -> DataFrame:
    """Bin numbers, the columns ``by``, and the summed weight of their rows."""
    numbered = df.select(*[bin_number(F.col(c), v).alias(c) for c, v in values.items()], *by, weight.alias("_weight"))
    return numbered.groupBy(*values, *by).agg(F.sum("_weight").alias("_weight"))


def with_values(df: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    """Values in the place of bin numbers."""
    return df.withColumns({c: F.element_at(F.array(*map(F.lit, v)), F.col(c) + 1) for c, v in values.items()})


class Cells:
    """Summed rows of two classes as arrays: bins, fold, and rows of either class."""

    def __init__(self, rows: pd.DataFrame, columns: list[str], label: str, fold: str):
        keys = [*columns, fold]
        wide = rows.pivot_table(index=keys, columns=label, values="_weight", aggfunc="sum", fill_value=0.0)
        self.bins = np.stack([wide.index.get_level_values(c).to_numpy(np.int32) for c in columns], axis=1)
        self.fold = wide.index.get_level_values(fold).to_numpy()
        self.rows = np.stack([wide[c].to_numpy(float) if c in wide else np.zeros(len(wide)) for c in (0.0, 1.0)], axis=1)


#: Nodes whose histograms are held at once.
_NODES = 8192


def _best_splits(node: np.ndarray, bins: np.ndarray, rows: np.ndarray, total: np.ndarray, asked: np.ndarray, least: int, width: int):
    """Of each node the feature and bin of its best split by Gini impurity, and what it gains; 0 where there is none."""
    k = len(total)
    gain, feature, cut = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
    n = total.sum(axis=1)
    own = (total**2).sum(axis=1) / n
    for j in range(asked.shape[1]):
        own_bin = bins[np.arange(len(node)), asked[node, j]]
        place = node * width + own_bin
        left = [np.cumsum(np.bincount(place, rows[:, c], k * width).reshape(k, width), axis=1)[:, :-1] for c in (0, 1)]
        size = left[0] + left[1]
        rest = n[:, None] - size
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (left[0] ** 2 + left[1] ** 2) / size + ((total[:, :1] - left[0]) ** 2 + (total[:, 1:] - left[1]) ** 2) / rest
        pure[(size < max(least, 1)) | (rest < max(least, 1))] = -np.inf
        best = pure.argmax(axis=1)
        gained = (pure[np.arange(k), best] - own) / n
        better = gained > np.maximum(gain, 1e-12)
        gain[better], feature[better], cut[better] = gained[better], asked[better, j], best[better]
    return gain, feature, cut


def grow(bins: np.ndarray, rows: np.ndarray, held: np.ndarray, depths: list[int], least: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Grow a tree level by level; yields, of each depth, the share of class 1 where each of ``held`` ends.

    A tree that may be less deep is the upper part of this one. Each node splits by the best of as many random
    features as the root of their number, rounded up; a side has at least ``least`` rows.
    """
    features, width = bins.shape[1], int(max(bins.max(initial=0), held.max(initial=0))) + 2
    drawn = rng.poisson(rows).astype(float)  # each row is drawn as often as Poisson(1) says
    kept = np.flatnonzero(drawn.sum(axis=1))
    bins, rows, node = bins[kept], drawn[kept], np.zeros(len(kept), np.int64)
    share, open_, spot = np.full(len(held), 0.5), np.arange(len(held)), np.zeros(len(held), np.int64)
    k = 1
    for depth in range(max(depths) + 1):
        if len(node):
            total = np.stack([np.bincount(node, rows[:, c], k) for c in (0, 1)], axis=1)
            share[open_] = (total[:, 1] / total.sum(axis=1))[spot]
        if depth in depths:
            yield share.copy()
        if not len(node):
            continue
        asked = np.argsort(rng.random((k, features)), axis=1)[:, : math.ceil(math.sqrt(features))]
        found = []
        order = np.argsort(node, kind="stable") if k > _NODES else None
        for first in range(0, k, _NODES):
            last = min(k, first + _NODES)
            if order is None:
                some = slice(None)
            else:
                some = order[slice(*np.searchsorted(node, (first, last), sorter=order))]
            found.append(_best_splits(node[some] - first, bins[some], rows[some], total[first:last], asked[first:last], least, width))
        gain, feature, cut = (np.concatenate(x) for x in zip(*found))
        split = gain > 0
        child = np.cumsum(split) * 2 - 2
        k = 2 * int(split.sum())
        going = split[node]
        bins, rows, node = bins[going], rows[going], node[going]
        node = child[node] + (bins[np.arange(len(node)), feature[node]] > cut[node])
        going = split[spot]
        open_, spot = open_[going], spot[going]
        spot = child[spot] + (held[open_, feature[spot]] > cut[spot])


def area(score: np.ndarray, rows: np.ndarray) -> float:
    """Area under the ROC curve of summed rows; equal scores count half."""
    _, place = np.unique(score, return_inverse=True)
    negative, positive = (np.bincount(place, rows[:, c]) for c in (0, 1))
    if not negative.sum() or not positive.sum():  # as MLlib has it
        return float(bool(positive.sum())) if negative.sum() or positive.sum() else 0.5
    below = np.cumsum(negative) - negative / 2
    return float((positive * below).sum() / (positive.sum() * negative.sum()))


def search_forests(df: DataFrame, columns: list[str], label: str, fold: str, folds: int, grid: list[dict], seed: int = 42, block: int = 25) -> np.ndarray | None:
    """Area under the ROC curve of each point of a grid (rows) in each fold, from forests of the other folds' rows.

    ``df`` holds :func:`cells` by label and fold. A point has ``numTrees``, ``maxDepth`` and ``minInstancesPerNode``.
    Points that differ in the first two share trees: the first trees of a larger forest, and the upper levels of
    deeper trees, are just what a forest of that size and depth would draw. None where the cells are too many or of
    other classes than 0 and 1.
    """
    spark = df.sparkSession
    if df.count() > MOST_CELLS or df.filter(F.col(label).isNull() | ~F.col(label).isin(0.0, 1.0)).limit(1).count():
        return None
    known = Cells(df.toPandas(), columns, label, fold)
    shared = spark.sparkContext.broadcast((known.bins, known.fold, known.rows))
    depths = sorted({p["maxDepth"] for p in grid})
    jobs = []
    for least in sorted({p["minInstancesPerNode"] for p in grid}):
        cuts = [0, *sorted({p["numTrees"] for p in grid if p["minInstancesPerNode"] == least})]
        starts = [(a, min(a + block, high)) for low, high in pairwise(cuts) for a in range(low, high, block)]
        jobs += [(f, least, a, b) for f in range(folds) for a, b in starts]
    trees = spark.createDataFrame(jobs, "fold int, least int, first int, last int").repartitionByRange(len(jobs), "first", "fold", "least")

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, fold_, rows = shared.value
        for batch in batches:
            for f, least, first, last in batch.itertuples(index=False):
                test = fold_ == f
                sums = {d: 0.0 for d in depths}
                for tree in range(first, last):
                    rng = np.random.default_rng([seed, f, least, tree])
                    for d, share in zip(depths, grow(bins[~test], rows[~test], bins[test], depths, least, rng), strict=True):
                        sums[d] = sums[d] + share
                out = [(f, least, last, d, np.ascontiguousarray(s).tobytes()) for d, s in sums.items()]
                yield pd.DataFrame(out, columns=["fold", "least", "last", "depth", "scores"])

    def measured(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        _, fold_, rows = shared.value
        own, out, score = rows[fold_ == key[0]], [], 0.0
        for last, payload in blocks.sort_values("last")[["last", "scores"]].itertuples(index=False):
            score = score + np.frombuffer(payload)
            out.append((*key, last, area(score, own)))
        return pd.DataFrame(out, columns=["fold", "least", "depth", "last", "auc"])

    sums = trees.mapInPandas(grown, "fold int, least int, last int, depth int, scores binary")
    areas = sums.groupBy("fold", "least", "depth").applyInPandas(measured, "fold int, least int, depth int, last int, auc double")
    by = {tuple(r)[:4]: r["auc"] for r in areas.collect()}
    shared.unpersist()
    return np.array([[by[f, p["minInstancesPerNode"], p["maxDepth"], p["numTrees"]] for f in range(folds)] for p in grid])
