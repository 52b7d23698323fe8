"""Broker records as message envelopes.

The envelope operators take any frame with the broker's columns, batch or
streaming, so the connector that delivers the rows does not matter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.payload import MAP, decode_payload
from tidemill.functions.record import instant, utc_offset, wall_clock
from tidemill.operators.extract import moment, read_document


def kafka_options(
    servers: str,
    topics: list[str],
    starting: str = "latest",
    group_id: str | None = None,
    **options: str,
) -> dict[str, str]:
    """Options of Spark's Kafka source for a list of topics."""
    settings = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }
    if group_id:
        settings["kafka.group.id"] = group_id
    settings.update(options)
    return settings


def read_kafka(spark: SparkSession, servers: str, topics: list[str], **options) -> DataFrame:
    """Stream of Kafka records; needs the Kafka package on the classpath."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topics, **options)).load()


def _attributes(**pairs: Column) -> Column:
    return F.create_map(*[p for name, value in pairs.items() for p in (F.lit(name), value.cast("string"))])


def kafka_envelope(df: DataFrame) -> DataFrame:
    """Envelope of records with Kafka's column names."""
    key = F.col("key").cast("string")
    # Kafka's timestamp type codes.
    kind = F.when(F.col("timestampType") == 1, "LOG_APPEND_TIME").otherwise("CREATE_TIME") if (
        "timestampType" in df.columns
    ) else F.lit("CREATE_TIME")
    return df.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias(
            "message_id"
        ),
        decode_payload(F.col("value")).alias("data"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.lit("kafka").alias("source"),
        _attributes(
            topic=F.col("topic"),
            partition=F.col("partition"),
            offset=F.col("offset"),
            key=key,
            timestamp_type=kind,
        ).alias("attributes"),
        key.alias("partition_key"),
        F.col("offset").cast("decimal(38,0)").alias("offset"),
    )


def kinesis_envelope(df: DataFrame) -> DataFrame:
    """Envelope of records with ``sequence_number``, ``data``, ``partition_key``,
    ``shard_id`` and ``arrival``. Sequence numbers do not fit 64 bits."""
    return df.select(
        F.col("sequence_number").alias("message_id"),
        decode_payload(F.col("data")).alias("data"),
        F.col("arrival").cast("timestamp").alias("timestamp"),
        F.lit("kinesis").alias("source"),
        _attributes(
            partition_key=F.coalesce("partition_key", F.lit("")),
            shard_id=F.col("shard_id"),
            sequence_number=F.col("sequence_number"),
        ).alias("attributes"),
        F.col("partition_key"),
        F.col("sequence_number").try_cast("decimal(38,0)").alias("offset"),
    )


def pubsub_envelope(df: DataFrame) -> DataFrame:
    """Envelope of records with ``message_id``, ``data``, ``publish_time`` and ``attributes``."""
    return df.select(
        "message_id",
        decode_payload(F.col("data")).alias("data"),
        F.col("publish_time").cast("timestamp").alias("timestamp"),
        F.lit("pubsub").alias("source"),
        "attributes",
        F.try_element_at("attributes", F.lit("key")).alias("partition_key"),
        F.lit(None).cast("decimal(38,0)").alias("offset"),
    )


def envelope_from_json(
    df: DataFrame, column: str = "value", processing_time: Column | dt.datetime | str | None = None
) -> DataFrame:
    """Envelope from its own JSON form; a missing time is the processing time."""
    staged, record = read_document(df.withColumn("_now", moment(processing_time)), column)
    staged = staged.selectExpr(
        "*",
        f"{wall_clock(record.text('timestamp'))} AS _wall",
        f"{utc_offset(record.text('timestamp'))} AS _offset",
    )
    return staged.selectExpr(
        f"{record.text('message_id')} AS message_id",
        f"{record.text('data')} AS data",
        f"coalesce({instant('_wall', '_offset')}, _now) AS timestamp",
        f"{record.text('source')} AS source",
        f"coalesce(from_json({record.text('attributes')}, '{MAP}'), CAST(map() AS {MAP})) AS attributes",
        f"{record.text('partition_key')} AS partition_key",
        f"try_cast({record.text('offset')} AS DECIMAL(38,0)) AS offset",
    )


def ingest_stats(messages: DataFrame, ok: Column) -> DataFrame:
    """Good and failed messages per source."""
    return messages.groupBy("source").agg(
        F.count_if(ok).alias("message_count"), F.count_if(~ok).alias("error_count")
    )


def process_messages(messages: DataFrame, function) -> DataFrame:
    """Apply a per-message Python function in Arrow batches.

    ``function`` takes a message as a dictionary and returns one. A message it
    raises on comes back with ``status = 'failed'`` and the error text.
    """
    import json

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for message in batch.to_dict("records"):
                try:
                    rows.append((message["message_id"], "success", json.dumps(function(message), default=str), None))
                except Exception as error:  # the function is user code
                    rows.append((message["message_id"], "failed", None, str(error)))
            yield pd.DataFrame(rows, columns=["message_id", "status", "result", "error"])

    return messages.mapInPandas(run, "message_id string, status string, result string, error string")
