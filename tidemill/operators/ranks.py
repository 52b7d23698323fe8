"""Exact running totals and order statistics without one-task sorts.

A plain ``Window.partitionBy(key).orderBy(value)`` or ``percentile`` puts a
whole key into one task. Here values go into order-preserving buckets first:
equal values are combined before the shuffle, each (key, bucket) is sorted on
its own, and a small per-bucket table carries the totals across buckets. A key
that holds a third of all rows is thus spread over all its buckets.

The bucket is a pure function of the value, so a task that is run again after
an executor is lost files its rows in the same buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS_PER_E = 512.0
#: About so many different values are put in order by one task.
PART_VALUES = 8192.0
#: Groups of up to so many rows are aggregated by one task at once, values and all.
CALM_ROWS = 16_384


def magnitude_bucket(value: Column, per_e: float = BUCKETS_PER_E) -> Column:
    """Order-preserving bucket: equal steps on a signed logarithmic scale."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_e).cast("bigint")


def unit_bucket(value: Column, buckets: int = 4096) -> Column:
    """Order-preserving bucket for values spread evenly over [0, 1]."""
    return F.floor(value * buckets).cast("bigint")


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: str,
    measures: dict[str, str],
) -> DataFrame:
    """Add inclusive running sums of ``measures`` per key in ``order``.

    ``measures`` maps an output name to an input column. Rows with equal
    ``order`` receive the same total. One shuffle of the rows on
    (keys, bucket) serves both the offset join and the window.
    """
    rows = df.withColumn("_bucket", bucket)
    slots = [*keys, "_bucket"]
    totals = rows.groupBy(*slots).agg(
        *[F.sum(column).alias(f"_t_{name}") for name, column in measures.items()]
    )
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *slots,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in measures
        ],
    )
    inside = (
        W.partitionBy(*slots).orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    joined = null_safe_join(rows, offsets, slots)
    summed = joined.withColumns(
        {
            name: F.col(f"_o_{name}") + F.sum(column).over(inside)
            for name, column in measures.items()
        }
    )
    return summed.drop("_bucket", *[f"_o_{name}" for name in measures])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for key in keys:
        test = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Column],
    bucket: Column | None = None,
) -> DataFrame:
    """Exact values at given ranks of every group, one row per group.

    ``ranks`` maps an output name to a zero-based rank written over the column
    ``n``, the number of non-null values in the group. The result holds
    ``keys``, ``n`` and one column per name.
    """
    bucket = magnitude_bucket(F.col(value)) if bucket is None else bucket
    grouping = keys or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    distinct = (
        source.filter(F.col(value).isNotNull())
        .groupBy(*grouping, bucket.alias("_bucket"), F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    histogram = distinct.groupBy(*grouping, "_bucket").agg(
        F.sum("_copies").alias("_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min("_value").cast("double").alias("_low"),
        F.max("_value").cast("double").alias("_high"),
    )
    upto = W.partitionBy(*grouping).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*grouping)
    placed = histogram.withColumns(
        {
            "_end": F.sum("_rows").over(upto),
            "n": F.sum("_rows").over(whole),
        }
    ).withColumn("_start", F.col("_end") - F.col("_rows"))
    names = list(ranks)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_name"), rank.cast("bigint").alias("_rank"))
            for name, rank in ranks.items()
        ]
    )
    targets = (
        placed.withColumn(
            "_wanted",
            F.filter(
                wanted,
                lambda w: (w["_rank"] >= F.col("_start")) & (w["_rank"] < F.col("_end")),
            ),
        )
        .filter(F.size("_wanted") > 0)
        .select(*grouping, "_bucket", "_start", "n", "_wanted", "_low", "_high", "_distinct")
    )
    # Narrow data fills few buckets: one that is asked for is cut again, evenly
    # between its own ends, until a part holds some thousand values.
    parts = F.ceil(F.col("_distinct") / PART_VALUES)
    share = F.try_divide(F.col("_value").cast("double") - F.col("_low"), F.col("_high") - F.col("_low"))
    cut = F.least(parts - 1, F.floor(F.coalesce(share, F.lit(0.0)) * parts))
    rows = null_safe_join(distinct, targets, [*grouping, "_bucket"]).withColumn("_part", cut)
    in_part = rows.groupBy(*grouping, "_bucket", "_part").agg(F.sum("_copies").alias("_in_part"))
    earlier = W.partitionBy(*grouping, "_bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = in_part.select(
        *grouping, "_bucket", "_part", F.coalesce(F.sum("_in_part").over(earlier), F.lit(0)).alias("_shift")
    )
    candidates = null_safe_join(rows, shifts, [*grouping, "_bucket", "_part"]).withColumn(
        "_start", F.col("_start") + F.col("_shift")
    )
    inside = W.partitionBy(*grouping, "_bucket", "_part").orderBy("_value")
    hits = (
        candidates.withColumn(
            "_upto", F.col("_start") + F.sum("_copies").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
        )
        .withColumn(
            "_found",
            F.filter(
                "_wanted",
                lambda w: (w["_rank"] < F.col("_upto"))
                & (w["_rank"] >= F.col("_upto") - F.col("_copies")),
            ),
        )
        .filter(F.size("_found") > 0)
    )
    result = hits.groupBy(*grouping).agg(
        F.max("n").alias("n"),
        *[
            F.max(
                F.when(F.exists("_found", _named(name)), F.col("_value"))
            ).alias(name)
            for name in names
        ],
    )
    return result if keys else result.drop("_all")


def _named(name: str):
    return lambda w: w["_name"] == name


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    shares: dict[str, float],
    bucket: Column | None = None,
    calm_rows: int = CALM_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, as numpy and pandas define them.

    Groups of up to ``calm_rows`` values are aggregated at once. Larger ones, if
    a count finds any, go through :func:`order_statistics`. The result holds
    ``keys``, ``n`` and one column per name.
    """
    if not calm_rows:
        return _spread_quantiles(df, keys, value, shares, bucket)
    crowded = df.groupBy(*keys).agg(F.count(value).alias("_n")).filter(F.col("_n") > calm_rows)
    if crowded.isEmpty():
        return _calm_quantiles(df, keys, value, shares)
    if not keys:
        return _spread_quantiles(df, keys, value, shares, bucket)
    marked = null_safe_join(df, crowded.select(*keys, F.lit(True).alias("_crowded")), keys, "left")
    calm, large = marked.filter(F.col("_crowded").isNull()), marked.filter("_crowded")
    return _calm_quantiles(calm, keys, value, shares).unionByName(
        _spread_quantiles(large.drop("_crowded"), keys, value, shares, bucket)
    )


def _calm_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    found = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count(value).alias("n"), F.percentile(F.col(value).cast("double"), list(map(float, shares.values()))).alias("_q"))
        .filter("n > 0")
    )
    return found.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(shares)])


def _spread_quantiles(
    df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bucket: Column | None
) -> DataFrame:
    ranks: dict[str, Column] = {}
    n = F.col("n")
    for name, share in shares.items():
        position = (n - 1) * F.lit(float(share))
        ranks[f"_lo_{name}"] = F.floor(position)
        ranks[f"_hi_{name}"] = F.ceil(position)
    stats = order_statistics(df, keys, value, ranks, bucket)
    columns = []
    for name, share in shares.items():
        position = (n - 1) * F.lit(float(share))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return stats.select(*keys, "n", *columns)
