"""Sinks: written below the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F


from tidemill.catalog.records import DOCS, documents
from tidemill.catalog.registry import FEAT, NOW, TX, features, query, r7, with_
from tidemill.config import ValidationRules
from tidemill.operators.aggregate import aggregate_users
from tidemill.operators.extract import dead_letters
from tidemill.operators.store import FeatureTable, json_text
from tidemill.plans.features import FeatureSettings, feature_outputs
from tidemill.session import table, work_path
from tidemill.sinks import files
from tidemill.sinks.tables import Outputs, append_tables, write_both, write_to_store

SETTINGS = FeatureSettings(
    rules=ValidationRules(required=("amount",), ranges={"amount": (0, 4000)}), window=None, processing_time=NOW
)
DOC_OUTPUTS = """SELECT 'errors' AS output, count(*) FILTER (WHERE error IS NOT NULL) AS "rows" FROM docs
  UNION ALL SELECT 'features', count(*) FILTER (WHERE error IS NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000) FROM docs
  UNION ALL SELECT 'invalid_features', count(*) FILTER (WHERE error IS NULL AND (amount IS NULL OR amount NOT BETWEEN 0 AND 4000)) FROM docs
  UNION ALL SELECT 'aggregated_features', count(DISTINCT coalesce(user_id, 'unknown')) FILTER (WHERE error IS NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000) FROM docs"""


def outputs(spark, folder) -> Outputs:
    return feature_outputs(documents(spark, folder), SETTINGS, "value", work_path(spark, "checked"))


@query(
    "sink_jsonl",
    with_(
        FEAT,
        f"""SELECT 'features' AS output, count(*) AS "rows", {r7('sum(amount)')} AS total, count(amount) AS amounts FROM feat
           UNION ALL SELECT 'aggregated', count(DISTINCT user_id), {r7('sum(amount)')}, count(DISTINCT user_id) FROM feat""",
    ),
)
def sink_jsonl(spark, folder):
    """Feature and aggregate shards as JSON lines."""
    path = work_path(spark, "sink")
    rows = features(spark, folder)
    files.write_features(rows, aggregate_users(rows, None), path)
    back = spark.read.schema("amount double").json(f"{path}/features")
    totals = spark.read.schema("total_amount double").json(f"{path}/aggregated").select(F.col("total_amount").alias("amount"))

    def summary(df, name):
        return df.agg(
            F.lit(name).alias("output"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("amount").alias("total"),
            F.count("amount").alias("amounts"),
        )

    return summary(back, "features").unionByName(summary(totals, "aggregated"))


@query(
    "sink_csv_parquet",
    """SELECT kind, count(*) AS "rows", CAST(sum(l_linenumber) AS BIGINT) AS lines, round(max(l_extendedprice), 7) + 0.0 AS top
       FROM lineitem, (VALUES ('csv'), ('parquet')) k(kind) GROUP BY kind""",
)
def sink_csv_parquet(spark, folder):
    """CSV with a header and its Parquet twin hold the same rows."""
    rows = table(spark, folder, "lineitem").select("l_linenumber", "l_extendedprice")
    csv, parquet = files.write_training(rows, work_path(spark, "training") + ".csv")
    back = {
        "csv": spark.read.option("header", True).schema("l_linenumber int, l_extendedprice double").csv(csv),
        "parquet": spark.read.parquet(parquet),
    }
    frames = [
        df.agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("l_linenumber").alias("lines"),
            F.max("l_extendedprice").alias("top"),
        )
        for kind, df in back.items()
    ]
    return frames[0].unionByName(frames[1])


DOC_GOOD = "error IS NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000"
DOC_ROWS = f"""SELECT 'errors' AS output, message_id AS id, NULL::DOUBLE AS amount, error FROM docs WHERE error IS NOT NULL
  UNION ALL SELECT 'features', message_id, {r7('amount')}, NULL FROM docs WHERE {DOC_GOOD}
  UNION ALL SELECT 'invalid_features', message_id, {r7('amount')}, NULL FROM docs WHERE error IS NULL AND NOT coalesce({DOC_GOOD}, FALSE)"""
DOC_TOTALS = f"""SELECT 'aggregated_features' AS output, coalesce(user_id, 'unknown') AS id, {r7('sum(amount)')} AS amount, NULL AS error
  FROM docs WHERE {DOC_GOOD} GROUP BY 2"""
LAST_GOOD = f"""SELECT 'store' AS output, user_id AS id, {r7("arg_max(amount, (CASE WHEN bad_time THEN TIMESTAMP '" + NOW + "' ELSE wall - to_minutes(offset_minutes) END, message_id))")} AS amount,
  NULL AS error FROM docs WHERE {DOC_GOOD} AND user_id <> 'unknown' GROUP BY user_id"""


def output_rows(read, *names):
    """Every row of the outputs: its id, its amount and its error."""
    ids = {
        "errors": F.try_variant_get(F.try_parse_json("element"), "$.message_id", "string"),
        "invalid_features": F.col("features.message_id"),
        "aggregated_features": F.col("user_id"),
    }
    amounts = {
        "errors": F.lit(None).cast("double"),
        "invalid_features": F.col("features.amount"),
        "aggregated_features": F.col("total_amount"),
    }
    frames = []
    for name in names:
        error = F.col("error") if name == "errors" else F.lit(None).cast("string")
        frames.append(
            read(name).select(
                F.lit(name).alias("output"),
                ids.get(name, F.col("message_id")).alias("id"),
                amounts.get(name, F.col("amount")).alias("amount"),
                error.alias("error"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("sink_multi_table_rows", with_(DOCS, f"{DOC_ROWS} UNION ALL {DOC_TOTALS}"))
def sink_multi_table_rows(spark, folder):
    """The rows of all four tables after the batch came twice."""
    root = work_path(spark, "tables")
    frames = outputs(spark, folder)
    for _ in range(2):
        append_tables(frames, root, batch_id=0)
    names = ("features", "errors", "invalid_features", "aggregated_features")
    return output_rows(lambda name: spark.read.parquet(f"{root}/{name}"), *names)


@query("sink_dual_rows", with_(DOCS, f"{DOC_ROWS} UNION ALL {LAST_GOOD}"))
def sink_dual_rows(spark, folder):
    """Rows in files and the newest amount of each user in the store, after the batch came twice."""
    path = work_path(spark, "dual")
    frames = outputs(spark, folder)
    frames = Outputs(features=frames.features, errors=frames.errors, invalid=frames.invalid)
    for _ in range(2):
        write_both(spark, frames, f"{path}/store", f"{path}/files", 0, NOW, ["event_time", "message_id"])
    schema = "message_id string, amount double, error string, element string, features struct<message_id:string,amount:double>"
    rows = output_rows(lambda name: spark.read.schema(schema).json(f"{path}/files/{name}"), "features", "errors", "invalid_features")
    state = FeatureTable(spark, f"{path}/store").read()
    return rows.unionByName(
        state.select(
            F.lit("store").alias("output"),
            F.col("entity_id").alias("id"),
            json_text(F.col("features")["amount"]).try_cast("double").alias("amount"),
            F.lit(None).cast("string").alias("error"),
        )
    )


def row_counts(spark, root, suffix=""):
    frames = []
    for name in ("features", "errors", "invalid_features", "aggregated_features"):
        rows = spark.read.parquet(f"{root}/{name}{suffix}")
        frames.append(rows.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("rows")))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


@query("sink_multi_table", with_(DOCS, DOC_OUTPUTS))
def sink_multi_table(spark, folder):
    """Four tables; the batch is delivered twice and must not double."""
    root = work_path(spark, "tables")
    frames = outputs(spark, folder)
    for _ in range(2):
        append_tables(frames, root, batch_id=0)
    return row_counts(spark, root)


@query(
    "sink_kafka",
    with_(
        FEAT,
        f"""SELECT 'ml-features' AS topic, message_id, {r7('amount')} AS amount, TRUE AS null_key FROM feat""",
    ),
)
def sink_kafka(spark, folder):
    """Rows as the Kafka sink takes them: null key, JSON value."""
    rows = files.kafka_rows(features(spark, folder), "ml-features")
    document = F.try_parse_json("value")
    return rows.select(
        "topic",
        F.try_variant_get(document, "$.message_id", "string").alias("message_id"),
        F.try_variant_get(document, "$.amount", "double").alias("amount"),
        F.col("key").isNull().alias("null_key"),
    )


HALF_KEYED = f"""{TX}, keyed AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 'unknown' ELSE user_id END AS who FROM tx)"""


def half_keyed(spark, folder):
    k = F.col("account_age_days")
    return features(spark, folder).withColumn(
        "user_id", F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, "unknown").otherwise(F.col("user_id"))
    )


@query(
    "sink_feature_store",
    with_(
        HALF_KEYED,
        f"""SELECT who AS entity_id, {r7('arg_max(amount, CAST(message_id AS BIGINT))')} AS amount, arg_max(channel, CAST(message_id AS BIGINT)) AS channel,
             (SELECT count(*) FROM keyed WHERE who IS NULL OR who = 'unknown') AS dead FROM keyed WHERE who IS NOT NULL AND who <> 'unknown' GROUP BY who""",
    ),
)
def sink_feature_store(spark, folder):
    """Rows without a user become dead letters, the rest is merged in order."""
    path = work_path(spark, "store")
    rows = half_keyed(spark, folder).withColumn("sequence", F.col("message_id").cast("bigint"))
    dead = write_to_store(
        spark,
        rows,
        path,
        "transaction_features",
        processing_time=NOW,
        order=["sequence"],
        batch_id=0,
        dead_letter_path=f"{path}-dead",
    )
    written = spark.read.schema(dead.schema).parquet(f"{path}-dead")
    features_map = FeatureTable(spark, path).read()
    return features_map.select(
        "entity_id",
        json_text(F.col("features")["amount"]).try_cast("double").alias("amount"),
        json_text(F.col("features")["channel"]).alias("channel"),
        written.agg(F.count(F.lit(1))).scalar().alias("dead"),
    )


@query(
    "sink_dual",
    with_(
        DOCS,
        """SELECT 'errors' AS output, count(*) FILTER (WHERE error IS NOT NULL) AS "rows" FROM docs
           UNION ALL SELECT 'features', count(*) FILTER (WHERE good) FROM (SELECT error IS NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000 AS good FROM docs)
           UNION ALL SELECT 'store', count(DISTINCT user_id) FILTER (WHERE good AND user_id <> 'unknown') FROM (SELECT user_id, error IS NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000 AS good FROM docs)""",
    ),
)
def sink_dual(spark, folder):
    """Store and files from one batch, delivered twice."""
    path = work_path(spark, "dual")
    frames = outputs(spark, folder)
    frames = Outputs(features=frames.features, errors=frames.errors, invalid=frames.invalid)
    for _ in range(2):
        write_both(spark, frames, f"{path}/store", f"{path}/files", 0, NOW, ["event_time", "message_id"])
    state = FeatureTable(spark, f"{path}/store").read()
    counts = [state.agg(F.lit("store").alias("output"), F.count(F.lit(1)).alias("rows"))]
    for name in ("features", "errors"):
        rows = spark.read.text(f"{path}/files/{name}")
        counts.append(rows.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("rows")))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "dead_letter",
    with_(
        HALF_KEYED,
        f"""SELECT message_id, 'Missing or unknown user_id' AS error, 'WriteToFeatureStore' AS transform,
             strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, TRUE AS fits FROM keyed WHERE who IS NULL OR who = 'unknown'""",
    ),
)
def dead_letter(spark, folder):
    """Error form of rows without a key, cut to five hundred characters."""
    rows = dead_letters(half_keyed(spark, folder), "user_id", NOW)
    return rows.select(
        F.regexp_extract("element", '"message_id":"([^"]*)"', 1).alias("message_id"),
        "error",
        "transform",
        "timestamp",
        (F.length("element") <= 500).alias("fits"),
    )
