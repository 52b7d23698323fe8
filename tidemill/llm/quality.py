"""Document quality by hierarchical empirical Bayes.

A logistic classifier on the shape of a text gives each document's own evidence.
Its expected counts, summed by host and by path, become posteriors of sites: the
rate of a host is drawn to the global rate, that of a path to its host's, each
with the strength that the spread of the observed rates supports, so sparse
sites say little. A document's odds are its own, shifted by the odds of its path
against the global odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import text_of
from tidemill.session import materialize, work_path

#: Characters whose share of a text is a feature of its own.
MARKS = "|#$%&*!?.,;:-_/\\<>{}[]()=+~^\"'@"


def features(text: str) -> list[float]:
    """Shape of one text; all shares are 0 for an empty one."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    lowered = [w.lower() for w in words]
    shares = [
        raw[97:123].sum(),
        raw[65:91].sum(),
        raw[48:58].sum(),
        raw[32],
        raw[10],
        raw[128:].sum(),
        raw[:10].sum() + raw[11:32].sum(),
        *(raw[ord(c)] for c in MARKS),
    ]
    return [
        *(float(s) / size for s in shares),
        np.log1p(size),
        np.log1p(len(words)),
        len(words) and sum(map(len, words)) / n / 10,
        len(set(lowered)) / n,
        sum(a == b for a, b in zip(lowered, lowered[1:])) / n,
        sum(w.isupper() for w in words) / n,
        sum(w[0].isupper() for w in words) / n,
        sum(not any(map(str.isalpha, w)) for w in words) / n,
        len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
    ]


WIDTH = len(features(""))


def _featured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(rows, pa.list_(pa.float64()))], names=[*names, "features"]
            )

    return run


def featurize(docs: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Read every text once: doc_id, host, path and the features of the text.

    ``host`` and ``path`` name the columns of the sites. Null text counts as
    empty; other columns are ignored.
    """
    names = ["doc_id", "host", "path"]
    chosen = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), text_of().alias("text"))
    schema = T.StructType([*chosen.schema.fields[:3], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return materialize(chosen.mapInArrow(_featured(names), schema), work_path(docs.sparkSession, "quality-features"))


def _matrix(column: pa.Array, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = column.values.to_numpy().reshape(len(column), WIDTH)
    return np.column_stack([(x - center) / scale, np.ones(len(x))])


def _sums(make):
    """Add up an array over a task's batches and return it cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = make(batch) if total is None else total + make(batch)
        if total is not None:
            yield pa.record_batch(
                [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"]
            )

    return run


def _added(df: DataFrame, make, size: int) -> np.ndarray:
    """Sum of ``make`` over all batches; the driver gets ``size`` numbers."""
    cells = df.mapInArrow(_sums(make), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in cells.collect():
        out[row["cell"]] = row["value"]
    return out


def fit(labelled: DataFrame, ridge: float = 1.0, rounds: int = 12) -> dict[str, np.ndarray]:
    """Logistic regression by Newton's method over all rows (features, label 0 or 1).

    Rows with a null label are left out. Without both labels the classifier is
    flat and says 0.5, or the single label's smoothed rate.
    """
    rows = labelled.filter(F.col("label").isNotNull()).select("features", F.col("label").cast("double").alias("label"))
    ready = materialize(rows, work_path(labelled.sparkSession, "quality-labelled"))

    def moments(batch):
        x = batch.column("features").values.to_numpy().reshape(batch.num_rows, WIDTH)
        y = batch.column("label").to_numpy()
        return np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)])

    found = _added(ready, moments, 2 + 2 * WIDTH)
    n, positive = found[:2]
    center = found[2 : 2 + WIDTH] / max(1, n)
    spread = np.sqrt(np.maximum(found[2 + WIDTH :] / max(1, n) - center**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    weights = np.zeros(WIDTH + 1)
    weights[-1] = np.log((positive + 1) / (n - positive + 1))
    if not 0 < positive < n:
        return {"center": center, "scale": scale, "weights": weights}
    penalty = np.full(WIDTH + 1, ridge)
    penalty[-1] = 0
    for _ in range(rounds):

        def slopes(batch, w=weights):
            x = _matrix(batch.column("features"), center, scale)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (batch.column("label").to_numpy() - p)
            return np.concatenate([gradient, (x.T @ (x * (p * (1 - p))[:, None])).ravel()])

        size = WIDTH + 1
        found = _added(ready, slopes, size + size * size)
        gradient = found[:size] - penalty * weights
        step = np.linalg.solve(found[size:].reshape(size, size) + np.diag(penalty + 1e-9), gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return {"center": center, "scale": scale, "weights": weights}


def _scored(model: dict[str, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("features"), model["center"], model["scale"])
            p = 1 / (1 + np.exp(-np.clip(x @ model["weights"], -15, 15)))
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(p)], names=[*names, "doc_score"])

    return run


def _strength(groups: DataFrame, rate: str, toward: Column) -> float:
    """Weight of the prior, in documents, by moments of the group rates."""
    within = toward * (1 - toward)
    row = groups.select(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * (F.col(rate) - toward) * (F.col(rate) - toward)).alias("between"),
        (F.sum(F.col("n") * within) / F.sum("n")).alias("within"),
        F.sum("noise").alias("noise"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 1.0
    free = row["n"] - row["squares"] / row["n"]
    mean_noise = row["noise"] / row["n"]
    variance = (row["between"] - (row["groups"] - 1) * mean_noise) / free if free > 0 else 0.0
    return float(np.clip(row["within"] / variance - 1, 1.0, 1e6)) if variance > 0 else 1e6


def judge(featured: DataFrame, model: dict[str, np.ndarray], keep_at: float = 0.5) -> DataFrame:
    """One row per document: doc_id, host, path, doc_score, site_score, score, kept.

    ``featured`` comes from :func:`featurize`; null hosts and paths are sites of
    their own. ``score`` is the posterior probability of good quality, and
    documents at ``keep_at`` or above are kept. An empty table gives an empty
    result.
    """
    names = ["doc_id", "host", "path"]
    rows = featured.select(*names, "features")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("doc_score", T.DoubleType())])
    scored = materialize(rows.mapInArrow(_scored(model, names), schema), work_path(featured.sparkSession, "quality-scored"))
    p = F.col("doc_score")
    sums = [F.count("*").alias("n"), F.sum(p).alias("good"), F.sum(p * p).alias("good_squared")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), work_path(featured.sparkSession, "quality-paths"))
    # How much one document's evidence varies around its site's rate.
    noise = F.greatest(F.col("good_squared") - F.col("good") * F.col("good") / F.col("n"), F.lit(0.0)).alias("noise")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "good", "good_squared")])
    hosts = hosts.withColumn("rate", F.col("good") / F.col("n")).withColumn("noise", noise)
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    prior = F.lit(overall)
    host_strength = _strength(hosts, "rate", prior)
    drawn = hosts.select(
        F.col("host").alias("of_host"),
        ((F.col("good") + host_strength * prior) / (F.col("n") + host_strength)).alias("host_rate"),
    )
    sited = paths.join(drawn, F.col("host").eqNullSafe(F.col("of_host"))).withColumn("rate", F.col("good") / F.col("n")).withColumn("noise", noise)
    path_strength = _strength(sited, "rate", F.col("host_rate"))
    sites = sited.select(
        "of_host",
        F.col("path").alias("of_path"),
        ((F.col("good") + path_strength * F.col("host_rate")) / (F.col("n") + path_strength)).alias("site_score"),
    )
    at_site = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    logit = lambda q: F.log(q / (1 - q))
    odds = logit(p) + logit(F.col("site_score")) - logit(prior)
    return (
        scored.join(sites, at_site)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", F.col("score") >= keep_at)
        .select("doc_id", "host", "path", "doc_score", "site_score", "score", "kept")
    )
