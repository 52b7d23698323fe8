"""File and table sinks. Spark decides the number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "append", keep_nulls: bool = True) -> None:
    """JSON-line shards below a folder."""
    df.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def write_features(
    features: DataFrame, aggregated: DataFrame, path: str, object_store: bool = False, mode: str = "append"
) -> None:
    """Features and aggregates next to each other, on disk or in an object store."""
    if object_store and not path.startswith(("s3://", "s3a://")):
        raise ValueError(f"an object store was asked for, but {path} names none")
    write_json_lines(features, f"{path}/features", mode)
    write_json_lines(aggregated, f"{path}/aggregated", mode)


def write_training(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> list[str]:
    """Training data as CSV with a Parquet twin, or as Parquet alone."""
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    parquet = f"{stem}.parquet"
    if kind == "parquet":
        df.write.mode(mode).parquet(parquet)
        return [parquet]
    csv = f"{stem}.csv"
    df.write.mode(mode).parquet(parquet)
    # The CSV is made from the finished Parquet, so the plan runs once.
    twin = df.sparkSession.read.parquet(parquet)
    twin.write.mode(mode).option("header", True).csv(csv)
    return [csv, parquet]


def kafka_rows(df: DataFrame, topic: str | Column) -> DataFrame:
    """Rows for Spark's Kafka sink: null key, JSON value."""
    return df.select(
        F.lit(None).cast("binary").alias("key"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"),
        (F.lit(topic) if isinstance(topic, str) else topic).alias("topic"),
    )


def write_kafka(
    features: DataFrame,
    aggregated: DataFrame,
    servers: str,
    features_topic: str = "ml-features",
    aggregated_topic: str = "ml-aggregated",
) -> None:
    """Features and aggregates to their topics; needs the Kafka package."""
    for df, topic in ((features, features_topic), (aggregated, aggregated_topic)):
        kafka_rows(df, topic).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
