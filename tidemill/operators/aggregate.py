"""Aggregates over users, windows, groups and whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.config import WindowSpec
from tidemill.operators import ranks
from tidemill.session import materialize, work_path

CATEGORY_COUNTS = {
    "unique_merchants": "merchant_category",
    "unique_channels": "channel",
    "unique_payment_methods": "payment_method",
}
#: Columns that the user aggregates read.
_COUNTED = (
    "timestamp",
    "amount",
    "risk_score",
    "fraud_score",
    *CATEGORY_COUNTS.values(),
    "is_weekend",
    "is_night",
    "is_business_hours",
    "is_high_amount",
    "is_unusual_time",
)


def window_column(spec: WindowSpec, time: str) -> Column | None:
    """Grouping expression of a window setting; None for no windowing.

    Events a whole gap apart belong to two sessions. Spark's session window
    would join them, so it gets a gap that is one microsecond shorter, and the
    window ends that much earlier.
    """
    if spec.kind == "fixed":
        return F.window(time, spec.size)
    if spec.kind == "sliding":
        return F.window(time, spec.size, spec.slide)
    if spec.kind == "session":
        return F.session_window(time, f"{spec.gap} -1 microseconds")
    return None


#: Size of the quantile sketch: medians lie within 1 % of the rows of the exact one, at 99 % confidence.
KLL_K = 600
#: Relative standard error of the distinct counts of sketches, which keep 2 to the power of HLL_LOG2 registers at most.
DISTINCT_ERROR = 0.02
HLL_LOG2 = 12


def user_aggregates(columns: list[str], distinct: str = "exact", median: bool = False) -> list[Column]:
    """The aggregate list of a user window.

    ``distinct`` is ``exact`` for batch and ``set`` for streams, which do not
    allow a distinct count. ``sketch`` counts distinct values and finds medians
    from sketches of fixed size, within ``DISTINCT_ERROR`` and the bound of
    ``KLL_K``. Columns the frame lacks count as missing values.
    """

    def has(name: str) -> bool:
        return name in columns

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if has(name) else F.lit(0.0)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if has(name) else F.lit(False)

    def unique(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit("")) if has(name) else F.lit("")
        if distinct == "exact":
            return F.count_distinct(value)
        if distinct == "sketch":
            # The state of a group with few values is as small as they are. The sketch passes over empty texts.
            return F.hll_sketch_estimate(F.hll_sketch_agg(F.concat(F.lit("_"), value), HLL_LOG2))
        return F.size(F.collect_set(value)).cast("bigint")

    amount, risk, fraud = number("amount"), number("risk_score"), number("fraud_score")
    result = [
        F.min("timestamp").alias("window_start"),
        F.max("timestamp").alias("window_end"),
        F.count(F.lit(1)).alias("record_count"),
        F.sum(amount).alias("total_amount"),
        F.avg(amount).alias("avg_amount"),
        F.stddev_pop(amount).alias("std_amount"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        F.avg(risk).alias("avg_risk_score"),
        F.max(risk).alias("max_risk_score"),
        F.avg(fraud).alias("avg_fraud_score"),
        F.max(fraud).alias("max_fraud_score"),
        *[unique(source).alias(name) for name, source in CATEGORY_COUNTS.items()],
        F.count_if(flag("is_weekend")).alias("weekend_transactions"),
        F.count_if(flag("is_night")).alias("night_transactions"),
        F.count_if(flag("is_business_hours")).alias("business_hours_transactions"),
        F.avg(flag("is_high_amount").cast("int")).alias("high_amount_ratio"),
        F.avg(flag("is_unusual_time").cast("int")).alias("unusual_time_ratio"),
    ]
    if median and distinct == "sketch":
        sketch = F.kll_sketch_agg_double(amount, F.lit(KLL_K))
        result.append(F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)).alias("median_amount"))
    elif median:
        result.append(F.median(amount).alias("median_amount"))
    return result


# Output order of the user aggregates.
AGGREGATE_COLUMNS = (
    "window_start",
    "window_end",
    "record_count",
    "total_amount",
    "avg_amount",
    "std_amount",
    "min_amount",
    "max_amount",
    "median_amount",
    "avg_risk_score",
    "max_risk_score",
    "avg_fraud_score",
    "max_fraud_score",
    "unique_merchants",
    "unique_channels",
    "unique_payment_methods",
    "weekend_transactions",
    "night_transactions",
    "business_hours_transactions",
    "high_amount_ratio",
    "unusual_time_ratio",
)


def _keyed(df: DataFrame, spec: WindowSpec | None, time: str) -> tuple[DataFrame, list[str]]:
    df = df.withColumn("user_id", F.coalesce("user_id", F.lit("unknown")))
    window = None if spec is None else window_column(spec, time)
    if window is None:
        return df, ["user_id"]
    if spec.kind == "session":
        return df, ["user_id"]  # session bounds need the merged groups themselves
    return df.withColumn("window", window), ["user_id", "window"]


def aggregate_users(
    df: DataFrame,
    spec: WindowSpec | None = None,
    time: str = "event_time",
    calm_rows: int = ranks.CALM_ROWS,
) -> DataFrame:
    """Spending, risk, variety and timing per user and window, in batch.

    ``spec=None`` gives one row per user over the whole input, which is what
    training assembly joins on. The columns that count are written once, so the
    source is read once. Groups of up to ``calm_rows`` rows are aggregated at
    once, their medians and sets of values included; larger ones, of which most
    inputs have none, get exact distinct counts and the medians of
    :mod:`ranks`, so a very active user is never held in one task.
    """
    named = df.withColumn("user_id", F.coalesce("user_id", F.lit("unknown")))
    counted = [c for c in dict.fromkeys(("user_id", time, *_COUNTED)) if c in named.columns]
    rows = materialize(named.select(*counted), work_path(df.sparkSession, "users"))
    if spec is not None and spec.kind == "session":
        rows, keys = assign_sessions(rows, spec.gap, time), ["user_id", "window"]
    else:
        rows, keys = _keyed(rows, spec, time)
    crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > calm_rows).select(*keys)
    together = [*user_aggregates(rows.columns, "set", median=True)]
    if crowded.isEmpty():
        return rows.groupBy(*keys).agg(*together).select(*keys, *AGGREGATE_COLUMNS)
    calm = rows.join(crowded, keys, "left_anti").groupBy(*keys).agg(*together)
    large = rows.join(crowded, keys, "left_semi")
    main = large.groupBy(*keys).agg(*user_aggregates(rows.columns))
    values = large.select(*keys, F.coalesce("amount", F.lit(0.0)).alias("_amount"))
    medians = ranks.quantiles(values, keys, "_amount", {"median_amount": 0.5}, calm_rows=0).drop("n")
    names = [*keys, *AGGREGATE_COLUMNS]
    return calm.select(*names).unionByName(main.join(medians, keys, "left").select(*names))


def assign_sessions(df: DataFrame, gap: str, time: str = "event_time") -> DataFrame:
    """Give each row the bounds of its session as a ``window`` struct.

    Time is cut into slices as long as the gap, so no session breaks within a
    slice: all rows of a user's slice are of one session. The first and last
    instant of each slice say where sessions begin, and one row per slice is put
    in order, however many events it has. Rows without a time have no session.
    """
    span = F.expr(f"INTERVAL {gap}")
    df = df.withColumn("user_id", F.coalesce("user_id", F.lit("unknown")))
    micros = F.unix_micros(F.timestamp_seconds(F.lit(0)) + span)
    sliced = df.withColumn("_slice", F.floor(F.unix_micros(time) / micros))
    slices = sliced.filter(F.col("_slice").isNotNull()).groupBy("user_id", "_slice").agg(
        F.min(time).alias("_first"), F.max(time).alias("_last")
    )
    along = W.partitionBy("user_id").orderBy("_slice")
    before = F.lag("_last").over(along)
    opened = slices.withColumn("_opens", (before.isNull() | (F.col("_first") >= before + span)).cast("bigint"))
    numbered = opened.withColumn("_session", F.sum("_opens").over(along))
    whole = W.partitionBy("user_id", "_session")
    end = F.max("_last").over(whole) + span - F.expr("INTERVAL 1 MICROSECOND")
    bounds = numbered.select("user_id", "_slice", F.struct(F.min("_first").over(whole).alias("start"), end.alias("end")).alias("window"))
    return sliced.join(bounds, ["user_id", "_slice"]).drop("_slice").select(*df.columns, "window")


def aggregation_errors(aggregated: DataFrame) -> DataFrame:
    """Groups whose aggregates are no numbers: the amounts overflowed or were not finite."""
    numbers = [name for name, kind in aggregated.dtypes if kind == "double"]
    broken = F.filter(
        F.array(*[F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in numbers]), lambda name: name.isNotNull()
    )
    return aggregated.withColumn("_broken", broken).filter(F.size("_broken") > 0).select(
        F.concat(F.lit("not a finite number: "), F.array_join("_broken", ", ")).alias("error"),
        F.col("user_id").alias("key"),
        F.col("record_count").alias("feature_count"),
        F.lit("AggregateFeatures").alias("transform"),
    )


def user_rollup(df: DataFrame, label: str = "label") -> DataFrame:
    """First seen, volume and fraud share per user."""
    return (
        df.groupBy("user_id")
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum("amount").alias("total_amount"),
            F.avg("amount").alias("avg_amount"),
            F.sum(F.col(label).cast("bigint")).alias("fraud_count"),
        )
        .withColumn(
            "fraud_rate",
            F.coalesce(F.try_divide("fraud_count", "transaction_count"), F.lit(0.0)),
        )
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives and rate in one row, with a warning outside 1 to 50 percent."""
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("rate"),
    )
    return stats.withColumn(
        "warning",
        F.when(F.col("rows") == 0, "empty")
        .when(F.col("rate") < 0.01, "very low positive rate")
        .when(F.col("rate") > 0.5, "very high positive rate")
        .otherwise("ok"),
    )


def label_summary(df: DataFrame, by: str = "merchant_category", label: str = "label") -> DataFrame:
    """Total, positives and rate per category, most positives first."""
    return (
        df.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(F.col(label).cast("bigint")).alias("fraud"),
            F.avg(F.col(label).cast("double")).alias("rate"),
        )
        .orderBy(F.desc("fraud"), by)
    )


def group_rate(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Mean label per value of one column."""
    return df.groupBy(by).agg(F.avg(F.col(label).cast("double")).alias("rate"))


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Mean amount of positives over negatives, and mean risk of each class."""
    positive, negative = F.col(label) == 1, F.col(label) == 0
    return df.agg(
        F.try_divide(
            F.avg(F.when(positive, F.col("amount"))), F.avg(F.when(negative, F.col("amount")))
        ).alias("amount_ratio"),
        F.avg(F.when(positive, F.col("risk_score"))).alias("risk_positive"),
        F.avg(F.when(negative, F.col("risk_score"))).alias("risk_negative"),
    )


def prediction_summary(df: DataFrame, probability: str = "fraud_probability") -> DataFrame:
    """Count, high-risk count and share, and mean probability."""
    high = F.col(probability) > 0.5
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(high).alias("high_risk_count"),
        F.bround(F.avg(probability), 3).alias("average_fraud_probability"),
        F.bround(F.avg(high.cast("int")) * 100, 1).alias("high_risk_percentage"),
    )
