"""Distribution drift of features between a reference and later windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import ranks

EPSILON = 1e-4


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row per record and feature."""
    return df.select(
        *keep,
        F.explode(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
            )
        ).alias("_f"),
    ).select(*keep, "_f.*").filter(F.col("value").isNotNull())


def bin_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """Inner quantile edges per feature as a sorted array."""
    shares = {f"e{i}": i / bins for i in range(1, bins)}
    edges = ranks.quantiles(reference, ["feature"], "value", shares)
    return edges.select("feature", F.array(*shares).alias("edges"))


def histogram(values: DataFrame, edges: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Share of each bin per group; bin ``i`` holds values above ``i`` edges.

    All counts of a group come from one aggregate. ``edges`` has one row per
    feature column of the model.
    """
    placed = values.join(edges, "feature").withColumn(
        "_bin", F.aggregate("edges", F.lit(0), lambda n, e: n + (F.col("value") > e).cast("int"))
    )
    counts = placed.groupBy("feature", *by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("_bin") == i).alias(f"_b{i}") for i in range(bins)],
    )
    share = [F.greatest(F.col(f"_b{i}") / F.col("rows"), F.lit(EPSILON)) for i in range(bins)]
    return counts.select("feature", *by, "rows", F.array(*share).alias("shares"))


def _sum(pairs: Column, term) -> Column:
    return F.aggregate(F.transform(pairs, term), F.lit(0.0), lambda a, b: a + b)


def drift(
    current: DataFrame,
    reference: DataFrame,
    features: list[str],
    by: list[str],
    bins: int = 10,
    threshold: float = 0.1,
) -> DataFrame:
    """PSI, KL and JS divergence per feature and window against the reference.

    Bins are quantiles of the reference; empty bins count as a small share.
    """
    base = long_form(reference, features, [])
    edges = bin_edges(base, bins)
    expected = histogram(base, edges, [], bins).select("feature", F.col("shares").alias("q"))
    actual = histogram(long_form(current, features, by), edges, by, bins)
    joined = actual.join(expected, "feature")
    pairs = F.arrays_zip(F.col("shares").alias("p"), F.col("q"))

    def half(x, y):
        return x * F.log(2 * x / (x + y))

    scored = joined.withColumn("_pairs", pairs).select(
        "feature",
        *by,
        "rows",
        _sum(F.col("_pairs"), lambda s: (s["p"] - s["q"]) * F.log(s["p"] / s["q"])).alias("psi"),
        _sum(F.col("_pairs"), lambda s: s["p"] * F.log(s["p"] / s["q"])).alias("kl_divergence"),
        _sum(F.col("_pairs"), lambda s: (half(s["p"], s["q"]) + half(s["q"], s["p"])) / 2).alias("js_divergence"),
    )
    return scored.withColumn("drifted", F.col("psi") > threshold)


def drift_summary(drifted: DataFrame, by: list[str]) -> DataFrame:
    """Drifted features per window in order, and whether there are any."""
    return drifted.groupBy(*by).agg(
        F.max("psi").alias("drift_score"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
        F.max("drifted").alias("drift_detected"),
    )
