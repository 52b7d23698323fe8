"""Joins and set operations of training assembly and feature lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.config import ModelDefinition


def row_hash(df: DataFrame) -> Column:
    """Settles ties by content, so that the chosen row is the same in every run."""
    plain = [F.col(name) for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain) if plain else F.lit(0)


def dedup_first(
    df: DataFrame,
    key: str = "message_id",
    order: tuple[str, ...] = ("event_time",),
    placeholder: str = "unknown",
) -> DataFrame:
    """Keep the first row per id, unless every id is the placeholder.

    Spark pushes the ``= 1`` limit below the shuffle, so each task sends at
    most one row per id and an id shared by a third of the rows costs nothing.
    Whether every id is the placeholder is a scalar subquery. The branch that
    keeps all rows then reads placeholder rows only, a filter that Parquet
    answers from its statistics in the usual case.
    """
    facts = df.agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("some")
    ).select(
        ((F.col("some") == 0) | ((F.col("lo") == placeholder) & (F.col("hi") == placeholder))).alias("skip")
    )
    first = W.partitionBy(key).orderBy(*order, row_hash(df))
    kept = (
        df.filter(~facts.scalar())
        .withColumn("_rank", F.row_number().over(first))
        .filter("_rank = 1")
        .drop("_rank")
    )
    unset = df.filter((F.col(key).isNull() | (F.col(key) == placeholder)) & facts.scalar())
    return kept.unionByName(unset)


def join_aggregates(
    records: DataFrame,
    aggregates: DataFrame,
    model: ModelDefinition | None = None,
    key: str = "user_id",
) -> DataFrame:
    """Left-join the mapped aggregate columns onto every record.

    The right side must have one row per key. Adaptive execution broadcasts it
    when it is small and splits skewed keys of the left side when it is not.
    Without the key on both sides the records pass through unchanged.
    """
    if "key" in aggregates.columns and key not in aggregates.columns:
        aggregates = aggregates.withColumnRenamed("key", key)
    if key not in records.columns or key not in aggregates.columns:
        return records
    if model is not None and model.aggregated:
        wanted = [m.source for m in model.aggregated.values()]
    else:
        wanted = ["record_count", "avg_amount", "avg_risk_score"]
    columns = [c for c in dict.fromkeys(wanted) if c in aggregates.columns]
    return records.join(aggregates.select(key, *columns), key, "left")


def join_labels(
    records: DataFrame,
    labels: DataFrame,
    key: str = "message_id",
    label: str = "label",
) -> DataFrame:
    """Left-join one label per id; records without a label get 0."""
    single = labels.groupBy(key).agg(F.min(label).alias("_label"))
    return (
        records.join(single, key, "left")
        .withColumn(label, F.coalesce(F.col("_label").cast("int"), F.lit(0)))
        .drop("_label")
    )


def join_groups(frames: list[DataFrame], key: str = "key") -> DataFrame:
    """Full outer join of several aggregate groups on their key."""
    return reduce(lambda left, right: left.join(right, key, "full"), frames)


def left_join_first(
    records: DataFrame,
    profiles: DataFrame,
    key: str = "user_id",
    defaults: dict[str, object] | None = None,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Left-join the first profile per key and fill gaps with defaults."""
    defaults = defaults or {}
    fields = [c for c in profiles.columns if c != key]
    rank = W.partitionBy(key).orderBy(*order, row_hash(profiles))
    first = profiles.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
    joined = records.join(first.select(key, *fields), key, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    )


def union_errors(*frames: DataFrame) -> DataFrame:
    """Extraction, validation and aggregation errors as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Expected columns the frame lacks, read from the schema alone."""
    return [c for c in expected if c not in set(df.columns)]


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"the table has no {', '.join(sorted(missing))}")
    return df


def latest_per_key(
    df: DataFrame, keys: list[str], newest: list, count: int = 1, salts: int = 64
) -> DataFrame:
    """Newest ``count`` rows per key.

    Rows are ranked within finer and then coarser hashes of the row before they
    are ranked by key, so many tasks rank one key and each ranking but the last
    sees a small share of it; the last sees at most ``count`` rows of eight.
    """
    fine, coarse = F.pmod(F.xxhash64(*df.columns), F.lit(salts)), F.pmod(F.xxhash64(*df.columns), F.lit(8))
    for salt in (fine, coarse, None):
        groups = [*keys, "_salt"] if salt is not None else keys
        salted = df if salt is None else df.withColumn("_salt", salt)
        rank = F.row_number().over(W.partitionBy(*groups).orderBy(*newest))
        df = salted.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank", "_salt")
    return df


def best_run(runs: DataFrame, metric: str, per: list[str] | None = None) -> DataFrame:
    """Finished run with the highest metric, over all runs or per group."""
    finished = runs.filter(F.col("status") == "FINISHED")
    newest = [F.col(metric).desc_nulls_last(), F.col("run_id")]
    if per:
        return latest_per_key(finished, per, newest)
    return finished.orderBy(*newest).limit(1)
