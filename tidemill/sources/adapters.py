"""Views of the supplied tables in the shapes the operators expect.

``events`` plays the part of a transaction stream, of a prediction log and of
metric samples; ``k`` is the number inside its ``props`` document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERCHANTS = {
    "signup": "grocery",
    "view": "restaurant",
    "click": "electronics",
    "purchase": "jewelry",
    "error": "cash_advance",
}
PAYMENTS = ("credit_card", "debit_card", "digital_wallet", "bank_transfer")
CHANNELS = ("web", "mobile", "store")


def choose(number: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int") + 1)


def merchant(kind: Column) -> Column:
    pairs = [p for k, v in MERCHANTS.items() for p in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), kind)


def with_k(events: DataFrame) -> DataFrame:
    """Events with ``k`` as a generated column, so that it is parsed once per row."""
    parsed = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    return parsed.withColumn("k", F.explode(F.array("_k"))).drop("_k")


def transactions(events: DataFrame) -> DataFrame:
    """Events as flat transaction records."""
    return with_k(events).select(
        F.col("event_id").cast("string").alias("message_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp"),
        (F.col("value") * 10).alias("amount"),
        merchant(F.col("event_type")).alias("merchant_category"),
        choose(F.col("k"), PAYMENTS).alias("payment_method"),
        choose(F.col("k"), CHANNELS).alias("channel"),
        (F.col("k") / 100.0).cast("double").alias("risk_score"),
        ((99 - F.col("k")) / 100.0).cast("double").alias("fraud_score"),
        (F.col("k") * 20.0).cast("double").alias("account_balance"),
        F.col("k").cast("bigint").alias("account_age_days"),
        (F.col("k") % 7).cast("bigint").alias("transaction_count"),
    )


def raw_documents(events: DataFrame) -> DataFrame:
    """Events as JSON lines with every irregularity the extractor must handle.

    Which one a record has depends on ``k``: missing and null keys, numbers in
    text, text that is no number, offsets, and times that are no times.
    """
    k = F.col("k")
    amount = (F.col("value") * 10).cast("string")

    def piece(name: str, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    offset = choose(k, ("Z", "+05:00", "", "-03:30"))
    pieces = [
        piece("message_id", quoted(F.col("event_id").cast("string"))),
        piece(
            "timestamp",
            F.when(k % 25 == 7, F.lit('"not a time"')).otherwise(quoted(F.concat(stamp, offset))),
        ),
        F.when(k % 20 == 1, piece("user_id", "null")).when(
            k % 20 != 0, piece("user_id", quoted(F.col("user_id").cast("string")))
        ),
        F.when(k % 10 == 1, piece("amount", "null"))
        .when(k % 10 == 2, piece("amount", '"abc"'))
        .when(k % 10 == 3, piece("amount", quoted(F.concat(F.lit(" "), amount, F.lit(" ")))))
        .when(k % 10 == 4, piece("amount", F.concat(F.lit("-"), amount)))
        .when(k % 10 != 0, piece("amount", amount)),
        F.when(k % 11 == 0, piece("risk_score", "null"))
        .when(k % 11 == 1, piece("risk_score", '"bad"'))
        .otherwise(piece("risk_score", (k / 100.0).cast("string"))),
        F.when(k % 13 == 0, piece("account_age_days", '"3.5"'))
        .when(k % 13 == 1, piece("account_age_days", "3.7"))
        .when(k % 13 == 2, piece("account_age_days", '" 12 "'))
        .when(k % 13 != 3, piece("account_age_days", k.cast("string"))),
        F.when(k % 9 != 0, piece("account_balance", (k * 20).cast("string"))),
        piece("merchant_category", quoted(F.concat(F.lit("  "), merchant(F.col("event_type")), F.lit(" ")))),
        F.when(k % 8 == 1, piece("channel", "null")).when(
            k % 8 != 0, piece("channel", quoted(choose(k, CHANNELS)))
        ),
        piece("location", '{"country":"US","city":"X"}'),
        F.when(k % 6 == 0, piece("city", quoted(F.repeat(F.lit("long name "), 12)))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return with_k(events).select("event_id", "k", body.alias("value"))


def prediction_log(events: DataFrame) -> DataFrame:
    """Events as rows of the prediction log."""
    k = F.col("k")
    return with_k(events).select(
        F.col("event_id").cast("string").alias("request_id"),
        F.when(F.col("user_id") % 2 == 0, "fraud_detector").otherwise("churn").alias("model_name"),
        (1 + F.col("user_id") % 3).cast("string").alias("model_version"),
        F.col("ts").cast("timestamp").alias("request_timestamp"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "view", "cache_hit")
        .otherwise("success")
        .alias("status"),
        F.when(~F.col("event_type").isin("error", "view"), F.col("value") * 2).alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.when(k % 2 == 0, 500).otherwise(422))
        .otherwise(200)
        .alias("status_code"),
        F.when(F.col("event_type") == "error", choose(k, ("timeout", "validation", "model"))).alias("error_type"),
        choose(F.col("user_id"), ("api", "store", "loader", "stream")).alias("component"),
        F.col("user_id").cast("string").alias("user_id"),
        (k >= 50).cast("int").alias("predicted"),
        (k + F.col("user_id") % 7 >= 52).cast("int").alias("actual"),
        (F.col("value") * 10).alias("amount"),
    )


def metric_samples(events: DataFrame) -> DataFrame:
    """Events as metric samples with labels: counters and gauges."""
    return with_k(events).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "counter").otherwise("gauge").alias("kind"),
        F.concat(F.lit("app_"), F.col("event_type")).alias("name"),
        F.create_map(
            F.lit("shard"),
            (F.col("user_id") % 4).cast("string"),
            F.lit("channel"),
            choose(F.col("k"), CHANNELS),
        ).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
    )


def kafka_records(events: DataFrame) -> DataFrame:
    """Events with Kafka's columns; values are JSON, text, raw bytes or null by ``k``."""
    k = F.col("k")
    text = F.to_json(F.struct("event_id", "event_type"))
    return with_k(events).select(
        F.when(k % 5 != 0, F.col("user_id").cast("string").cast("binary")).alias("key"),
        F.when(k % 10 == 0, F.lit(None))
        .when(k % 10 == 1, F.col("event_type").cast("binary"))
        .when(k % 10 == 2, F.unhex(F.lit("FFFE80")))
        .otherwise(text.cast("binary"))
        .alias("value"),
        F.lit("transactions").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def training_runs(events: DataFrame) -> DataFrame:
    """One run per user and event type as an experiment run with metrics."""
    per = with_k(events).groupBy("user_id", "event_type").agg(
        F.avg(F.col("k") / 100.0).alias("_m"), F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_t")
    )
    return per.select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("run_id"),
        F.col("event_type").alias("model_name"),
        F.col("user_id").cast("string").alias("model_version"),
        (F.col("user_id") % 3).cast("string").alias("experiment"),
        F.when(F.col("user_id") % 5 == 0, "FAILED").otherwise("FINISHED").alias("status"),
        F.when(F.col("user_id") % 10 == 0, "production").otherwise("none").alias("deployment_status"),
        (0.5 + F.col("_m") * 0.7).alias("accuracy"),
        (0.4 + F.col("_m") * 0.8).alias("f1_score"),
        (0.45 + F.col("_m") * 0.7).alias("precision"),
        (0.35 + F.col("_m") * 0.9).alias("recall"),
        F.col("_t").cast("timestamp").alias("start_time"),
    )
