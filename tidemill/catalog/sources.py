"""File and message sources.

File queries write rows of the supplied tables below the shared folder and
read them back with the source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.records import codes_sql, documents
from tidemill.catalog.registry import EV, FEAT, MERCHANT_CASE, NOW, features, query, r7, with_
from tidemill.config import FRAUD_DETECTOR
from tidemill.functions.payload import decode_payload
from tidemill.session import table, work_path
from tidemill.sinks.files import write_json_lines
from tidemill.sources import adapters, files, messages, recorded
from tidemill.streaming.job import finish, start_file_query


@query(
    "src_jsonl",
    with_(
        EV,
        f"""SELECT CAST(event_id AS VARCHAR) AS message_id, '  ' || {MERCHANT_CASE} || ' ' AS merchant_category FROM ev WHERE k % 10 <> 9""",
    ),
)
def src_jsonl(spark, folder):
    """A tenth of the lines is cut off in the middle and must vanish."""
    path = work_path(spark, "jsonl")
    broken = F.expr("IF(k % 10 = 9, left(value, 20), value)")
    documents(spark, folder).select(broken.alias("value")).write.text(path)
    rows = files.read_json_lines(spark, path)
    return rows.select(
        F.try_variant_get("doc", "$.message_id", "string").alias("message_id"),
        F.try_variant_get("doc", "$.merchant_category", "string").alias("merchant_category"),
    )


@query("src_jsonl_sharded", with_(FEAT, f"SELECT message_id, user_id, {r7('amount')} AS amount FROM feat"))
def src_jsonl_sharded(spark, folder):
    """All shards of a prefix with a fixed schema."""
    path = work_path(spark, "shards")
    rows = features(spark, folder).select("message_id", "user_id", "amount")
    write_json_lines(rows.repartition(4), path)
    return files.read_json_shards(spark, f"{path}/part-", "message_id string, user_id string, amount double")


@query(
    "src_json_array",
    """SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id, round(o_totalprice, 7) + 0.0 AS amount,
         o_orderpriority AS merchant_category, CAST(o_orderkey % 2 AS BIGINT) AS label FROM orders""",
)
def src_json_array(spark, folder):
    """Files that each hold one JSON array of up to a thousand orders."""
    path = work_path(spark, "arrays")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("merchant_category"),
        (F.col("o_orderkey") % 2).cast("int").alias("label"),
    )
    arrays = orders.groupBy(F.floor(F.col("transaction_id").cast("bigint") / 1000).alias("block")).agg(
        F.to_json(F.collect_list(F.struct(*orders.columns))).alias("value")
    )
    arrays.write.partitionBy("block").text(path)
    return files.read_json_array(spark, f"{path}/block=*").select(*orders.columns)


@query(
    "src_kafka",
    with_(
        EV,
        """SELECT 'transactions' AS topic, CAST(user_id % 4 AS BIGINT) AS "partition", count(*) AS records, min(event_id) AS first_offset, max(event_id) AS last_offset
           FROM ev GROUP BY ALL""",
    ),
)
def src_kafka(spark, folder):
    """Records of each topic and partition with the range of their offsets.

    The connector is a separate package; records with its layout come from a
    table and go through the envelope.
    """
    envelopes = messages.kafka_envelope(adapters.kafka_records(table(spark, folder, "events")))
    attribute = F.col("attributes")
    return envelopes.groupBy(attribute["topic"].alias("topic"), attribute["partition"].cast("bigint").alias("partition")).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("offset").cast("bigint").alias("first_offset"),
        F.max("offset").cast("bigint").alias("last_offset"),
    )


@query(
    "src_kafka_stream",
    with_(
        EV,
        """SELECT 'transactions' AS topic, CAST(user_id % 4 AS BIGINT) AS "partition", event_id AS "offset", ts AS timestamp, 'transactions-' || (user_id % 4) || '-' || event_id AS message_id FROM ev""",
    ),
)
def src_kafka_stream(spark, folder):
    """All records of a recorded topic, streamed by offset in two runs of one query; the second half comes between them."""
    root = work_path(spark, "topics")
    records = adapters.kafka_records(table(spark, folder, "events"))
    middle = table(spark, folder, "events").agg(F.avg("event_id")).scalar()
    for half in (F.col("offset") < middle, F.col("offset") >= middle):
        recorded.record_topics(records.filter(half), f"{root}/log")
        stream = messages.kafka_envelope(recorded.read_recorded(spark, f"{root}/log", ["transactions"], "earliest"))
        finish([start_file_query(stream, f"{root}/out", f"{root}/checkpoint")])
    attribute = F.col("attributes")
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(
        attribute["topic"].alias("topic"),
        attribute["partition"].cast("bigint").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
        "timestamp",
        "message_id",
    )


PAYLOAD = """CASE WHEN k % 10 = 0 THEN '{"raw_data":null}' WHEN k % 10 = 1 THEN '{"raw_data":"' || event_type || '"}'
  WHEN k % 10 = 2 THEN '{"raw_data_b64":"//6A"}' ELSE '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' END"""


@query(
    "src_envelope_kafka",
    with_(
        EV,
        f"""SELECT 'transactions-' || (user_id % 4) || '-' || event_id AS message_id, {PAYLOAD} AS data, ts AS timestamp, 'kafka' AS source,
             CASE WHEN k % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS partition_key, CAST(event_id AS DOUBLE) AS "offset",
             CAST(event_id AS VARCHAR) AS offset_attribute, 'CREATE_TIME' AS timestamp_type FROM ev""",
    ),
)
def src_envelope_kafka(spark, folder):
    envelope = messages.kafka_envelope(adapters.kafka_records(table(spark, folder, "events")))
    return envelope.select(
        "message_id",
        "data",
        "timestamp",
        "source",
        "partition_key",
        "offset",
        F.col("attributes")["offset"].alias("offset_attribute"),
        F.col("attributes")["timestamp_type"].alias("timestamp_type"),
    )


@query(
    "src_envelope_kinesis",
    with_(
        EV,
        f"""SELECT '49600000000000000000' || (1000000 + event_id) AS message_id, {PAYLOAD} AS data, ts AS timestamp, 'kinesis' AS source,
             CAST(user_id AS VARCHAR) AS partition_key, '49600000000000000000' || (1000000 + event_id) AS offset_text,
             'shard-' || (user_id % 4) AS shard_id FROM ev""",
    ),
)
def src_envelope_kinesis(spark, folder):
    """Sequence numbers of 27 digits stay whole."""
    records = adapters.kafka_records(table(spark, folder, "events")).select(
        F.concat(F.lit("49600000000000000000"), (1000000 + F.col("offset")).cast("string")).alias("sequence_number"),
        F.col("value").alias("data"),
        F.coalesce(F.col("key").cast("string"), F.lit(None)).alias("partition_key"),
        F.concat(F.lit("shard-"), F.col("partition").cast("string")).alias("shard_id"),
        F.col("timestamp").alias("arrival"),
        "offset",
    )
    users = table(spark, folder, "events").select(F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("u"))
    records = records.join(users, "offset").withColumn("partition_key", F.col("u"))
    envelope = messages.kinesis_envelope(records)
    return envelope.select(
        "message_id",
        "data",
        "timestamp",
        "source",
        "partition_key",
        F.col("offset").cast("string").alias("offset_text"),
        F.col("attributes")["shard_id"].alias("shard_id"),
    )


@query(
    "src_envelope_pubsub",
    with_(
        EV,
        f"""SELECT CAST(event_id AS VARCHAR) AS message_id, {PAYLOAD} AS data, ts AS timestamp, 'pubsub' AS source,
             CASE WHEN k % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS partition_key FROM ev""",
    ),
)
def src_envelope_pubsub(spark, folder):
    records = adapters.kafka_records(table(spark, folder, "events")).select(
        F.col("offset").cast("string").alias("message_id"),
        F.col("value").alias("data"),
        F.col("timestamp").alias("publish_time"),
        F.map_filter(F.create_map(F.lit("key"), F.col("key").cast("string")), lambda _, v: v.isNotNull()).alias("attributes"),
    )
    return messages.pubsub_envelope(records).select("message_id", "data", "timestamp", "source", "partition_key")


@query("decode_payload", with_(EV, f"SELECT event_id, {PAYLOAD} AS data FROM ev"))
def decode(spark, folder):
    """JSON, plain text, bytes that are not UTF-8, and null."""
    records = adapters.kafka_records(table(spark, folder, "events"))
    return records.select(F.col("offset").alias("event_id"), decode_payload(F.col("value")).alias("data"))


@query(
    "envelope_from_dict",
    with_(
        EV,
        f"""SELECT CAST(event_id AS VARCHAR) AS message_id, CASE WHEN k % 4 = 0 THEN TIMESTAMP '{NOW}' WHEN k % 4 = 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
               ELSE date_trunc('second', ts) END AS timestamp, 'kafka' AS source, CASE WHEN k % 3 = 0 THEN 'p' END AS partition_key,
             CAST(event_id AS DOUBLE) AS "offset", CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS attributes FROM ev""",
    ),
)
def envelope_from_dict(spark, folder):
    """Missing times become the processing time, ``Z`` and offsets are read."""
    k = F.col("k")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.concat(stamp, F.lit("+02:00"))).otherwise(F.concat(stamp, F.lit("Z")))
    body = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("message_id"),
            F.struct("event_type").alias("data"),
            text.alias("timestamp"),
            F.lit("kafka").alias("source"),
            F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("b"))).alias("attributes"),
            F.when(k % 3 == 0, "p").alias("partition_key"),
            F.col("event_id").alias("offset"),
        )
    )
    rows = adapters.with_k(table(spark, folder, "events")).select(body.alias("value"))
    return messages.envelope_from_json(rows, processing_time=NOW).select(
        "message_id", "timestamp", "source", "partition_key", "offset", F.size("attributes").alias("attributes")
    )


@query(
    "ingest_stats",
    with_(
        EV,
        """SELECT 'kafka' AS source, count(*) FILTER (WHERE k % 10 > 2) AS message_count, count(*) FILTER (WHERE k % 10 <= 2) AS error_count FROM ev""",
    ),
)
def ingest_stats(spark, folder):
    envelope = messages.kafka_envelope(adapters.kafka_records(table(spark, folder, "events")))
    ok = ~F.col("data").contains('"raw_data')
    return messages.ingest_stats(envelope, ok)


@query(
    "process_messages",
    with_(
        EV,
        """SELECT 'transactions-' || (user_id % 4) || '-' || event_id AS message_id, CASE WHEN k % 10 <= 2 THEN 'failed' ELSE 'success' END AS status,
             CASE WHEN k % 10 > 2 THEN '{"kind": "' || upper(event_type) || '"}' END AS result FROM ev""",
    ),
)
def process_messages(spark, folder):
    """A user's Python function per message, failures set apart."""
    import json

    def work(message):
        return {"kind": json.loads(message["data"])["event_type"].upper()}

    envelope = messages.kafka_envelope(adapters.kafka_records(table(spark, folder, "events"))).select("message_id", "data")
    return messages.process_messages(envelope, work).select("message_id", "status", "result")


TRAINING_FILE = f"""SELECT CAST(hour_of_day AS DOUBLE) AS hour_of_day, CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(CASE WHEN is_weekend THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend,
  CAST(transaction_count AS DOUBLE) AS transaction_count_24h, account_balance AS avg_amount_30d, {r7('amount')} AS amount,
  CAST(m.b AS DOUBLE) AS merchant_category_encoded, CAST(p.b AS DOUBLE) AS payment_method_encoded, CAST(CASE WHEN k >= 90 THEN 1 ELSE 0 END AS BIGINT) AS label
  FROM feat JOIN merchant_codes m ON m.n = merchant_category JOIN payment_codes p ON p.n = payment_method"""


@query("src_training_file", with_(f"{FEAT}, {codes_sql()}", TRAINING_FILE))
def src_training_file(spark, folder):
    """Training CSV read back in the model's column order."""
    from tidemill.functions.scalars import hash_encode

    rows = features(spark, folder).select(
        F.col("merchant_category").alias("spare"),
        hash_encode(F.col("payment_method"), 10).alias("payment_method_encoded"),
        hash_encode(F.col("merchant_category"), 100).alias("merchant_category_encoded"),
        "hour_of_day",
        "day_of_week",
        F.col("is_weekend").cast("int").alias("is_weekend"),
        F.col("transaction_count").alias("transaction_count_24h"),
        F.col("account_balance").alias("avg_amount_30d"),
        "amount",
        (F.col("account_age_days") >= 90).cast("int").alias("label"),
    )
    path = work_path(spark, "training") + ".csv"
    rows.write.option("header", True).csv(path)
    return files.read_training_file(spark, path, FRAUD_DETECTOR)


@query(
    "src_training_fallback",
    """SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, round(l_quantity, 7) + 0.0 AS l_quantity, l_returnflag, CAST(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS BIGINT) AS label FROM lineitem""",
)
def src_training_fallback(spark, folder):
    """Without the model's columns all other columns are features."""
    rows = table(spark, folder, "lineitem").select(
        "l_linenumber", "l_quantity", "l_returnflag", (F.col("l_tax") > 0.04).cast("int").alias("label")
    )
    path = work_path(spark, "training") + ".parquet"
    rows.write.parquet(path)
    return files.read_training_file(spark, path, FRAUD_DETECTOR)


@query("src_labels_csv", "SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(toxic AS BIGINT) AS label FROM labels")
def src_labels_csv(spark, folder):
    path = work_path(spark, "labels")
    table(spark, folder, "labels").select(
        "quality", F.col("toxic").alias("label"), F.col("doc_id").alias("message_id")
    ).write.option("header", True).csv(path)
    return files.read_labels(spark, path)
