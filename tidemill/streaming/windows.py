"""Windowed aggregates on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import WindowSpec
from tidemill.operators.aggregate import AGGREGATE_COLUMNS, user_aggregates, window_column


def aggregate_stream(
    features: DataFrame, spec: WindowSpec, time: str = "event_time", summaries: str = "exact"
) -> DataFrame:
    """User aggregates per event-time window.

    The watermark drops rows later than the allowed lateness and lets a window
    leave the state once it is over. Kind ``none`` has no window to close: each
    trigger yields the users it changes. With ``exact`` summaries a window's
    state holds its amounts and categories; with ``sketch`` it has the same size
    whatever the window's rows, and medians and distinct counts are within the
    bounds of :func:`tidemill.operators.aggregate.user_aggregates`.
    """
    if summaries not in ("exact", "sketch"):
        raise ValueError(f"no summaries are called {summaries}")
    rows = features.withColumn("user_id", F.coalesce("user_id", F.lit("unknown")))
    aggregates = user_aggregates(rows.columns, distinct="set" if summaries == "exact" else "sketch", median=True)
    window = window_column(spec, time)
    if window is None:
        return rows.groupBy("user_id").agg(*aggregates).select("user_id", *AGGREGATE_COLUMNS)
    return (
        rows.withWatermark(time, spec.lateness)
        .groupBy(window.alias("window"), "user_id")
        .agg(*aggregates)
        .select("user_id", "window", *AGGREGATE_COLUMNS)
    )


def output_mode(spec: WindowSpec) -> str:
    return "update" if spec.kind == "none" else "append"


def drop_redelivered(
    df: DataFrame, key: str = "message_id", time: str = "event_time", lateness: str = "5 minutes"
) -> DataFrame:
    """Each id once while it is within the watermark."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
