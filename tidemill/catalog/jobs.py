"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.records import DOCS, codes_sql, documents, raw_transactions
from tidemill.catalog.registry import EV, FEAT, LABELLED, NOW, features, query, r7, with_
from tidemill.catalog.validation import GAPS, RAW, gaps, raw_text
from tidemill.operators import store as S
from tidemill.operators.aggregate import aggregate_users
from tidemill.plans.features import batch_features
from tidemill.plans.quality_report import data_quality_report
from tidemill.plans.training import (
    assemble_training,
    prepare_training,
    store_to_training,
    write_training_set,
)
from tidemill.session import work_path

ASSEMBLED = f"""{LABELLED}, {codes_sql()}, agg AS (SELECT user_id, count(*) AS cnt, avg(amount) AS mean FROM feat GROUP BY user_id),
  assembled AS (SELECT message_id, hour_of_day, day_of_week, CAST(CASE WHEN is_weekend THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
    cnt AS transaction_count_24h, mean AS avg_amount_30d, amount, m.b AS merchant_category_encoded, p.b AS payment_method_encoded, label
  FROM labelled l JOIN agg ON agg.user_id = l.user_id JOIN merchant_codes m ON m.n = merchant_category
    JOIN payment_codes p ON p.n = payment_method)"""
TRAINING_COLUMNS = f"""CAST(hour_of_day AS BIGINT) AS hour_of_day, CAST(day_of_week AS BIGINT) AS day_of_week, is_weekend, transaction_count_24h,
  {r7('avg_amount_30d')} AS avg_amount_30d, {r7('amount')} AS amount, CAST(merchant_category_encoded AS BIGINT) AS merchant_category_encoded,
  CAST(payment_method_encoded AS BIGINT) AS payment_method_encoded, CAST(label AS BIGINT) AS label"""


@query(
    "batch_features",
    with_(
        DOCS,
        f"""SELECT 'features' AS output, count(*) AS "rows", {r7('sum(amount)')} AS total FROM docs WHERE error IS NULL
           UNION ALL SELECT 'errors', count(*), NULL FROM docs WHERE error IS NOT NULL""",
    ),
)
def batch_job(spark, folder):
    """JSON-line files in, feature and error files out."""
    root = work_path(spark, "batch")
    documents(spark, folder).select("value").write.text(f"{root}/in")
    batch_features(spark, f"{root}/in", f"{root}/out", processing_time=NOW)
    good = spark.read.schema("amount double").json(f"{root}/out/features")
    bad = spark.read.schema("error string").json(f"{root}/out/errors")
    return good.agg(
        F.lit("features").alias("output"), F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total")
    ).unionByName(
        bad.agg(F.lit("errors").alias("output"), F.count("error").alias("rows"), F.lit(None).cast("double").alias("total"))
    )


@query("assemble_training", with_(ASSEMBLED, f"SELECT {TRAINING_COLUMNS} FROM assembled"))
def assemble(spark, folder):
    """Every record twice in, once out: dedup, join, label, map."""
    rows = features(spark, folder)
    twice = rows.unionByName(rows)
    return assemble_training(twice, aggregate_users(rows, None), labeling_options={"noise_std": 0.0})


@query(
    "assemble_written",
    with_(
        LABELLED,
        f"""SELECT count(*) AS "rows", CAST(sum(label) AS BIGINT) AS positives, {r7('avg(label)')} AS rate FROM labelled""",
    ),
)
def assemble_written(spark, folder):
    """The written training set and the check of its class balance."""
    rows = features(spark, folder)
    training = assemble_training(rows, aggregate_users(rows, None), labeling_options={"noise_std": 0.0})
    path = work_path(spark, "assembled") + ".csv"
    write_training_set(spark, training, path)
    back = spark.read.option("header", True).csv(path)
    return back.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.avg(F.col("label").cast("int")).alias("rate"),
    )


PREPARED_ROWS = f"""SELECT hour_of_day, day_of_week, CAST(CASE WHEN k % 5 <> 0 AND is_weekend THEN 1 ELSE 0 END AS BIGINT) AS is_weekend, transaction_count AS transaction_count_24h,
  {r7('CASE WHEN k % 3 <> 0 THEN account_balance ELSE 0.0::DOUBLE END')} AS avg_amount_30d, {r7('amount')} AS amount, CAST(m.b AS BIGINT) AS merchant_category_encoded,
  CAST(p.b AS BIGINT) AS payment_method_encoded, CAST(CASE WHEN k >= 90 THEN 1 ELSE 0 END AS BIGINT) AS label
  FROM feat JOIN merchant_codes m ON m.n = merchant_category JOIN payment_codes p ON p.n = payment_method"""


@query("prepare_training", with_(f"{FEAT}, {codes_sql()}", PREPARED_ROWS))
def prepare(spark, folder):
    """Raw JSON arrays to training CSV and back."""
    root = work_path(spark, "prepare")
    raw = raw_transactions(spark, folder)
    raw.write.json(f"{root}/raw")
    table = prepare_training(spark.read.schema(raw.schema).json(f"{root}/raw"))
    table.write.option("header", True).csv(f"{root}/training")
    return spark.read.schema(table.schema).option("header", True).csv(f"{root}/training")


@query(
    "store_to_training",
    with_(
        f"""{LABELLED}, {codes_sql()}, newest AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(message_id AS BIGINT) DESC) = 1),
          agg AS (SELECT user_id, count(*) AS cnt, avg(amount) AS mean FROM feat GROUP BY user_id)""",
        f"""SELECT CAST(hour_of_day AS DOUBLE) AS hour_of_day, CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(CASE WHEN is_weekend THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
             CAST(cnt AS DOUBLE) AS transaction_count_24h, {r7('mean')} AS avg_amount_30d, {r7('amount')} AS amount, CAST(m.b AS BIGINT) AS merchant_category_encoded,
             CAST(p.b AS BIGINT) AS payment_method_encoded, CAST(label AS BIGINT) AS label
           FROM newest l JOIN agg ON agg.user_id = l.user_id JOIN merchant_codes m ON m.n = merchant_category JOIN payment_codes p ON p.n = payment_method""",
    ),
)
def from_store(spark, folder):
    """Both feature groups from the store, joined by entity."""
    rows = features(spark, folder)
    path = work_path(spark, "store")
    stored = S.FeatureTable(spark, path)
    records = rows.select("user_id", "message_id", "hour_of_day", "day_of_week", "is_weekend", "amount", "merchant_category", "payment_method")
    ordered = records.withColumn("sequence", F.col("message_id").cast("bigint"))
    stored.upsert(S.pack_features(ordered, "transaction_features", processing_time=NOW, order=["sequence"], drop=("sequence",)), 1)
    totals = aggregate_users(rows, None).select("user_id", "record_count", "avg_amount")
    stored.upsert(S.pack_features(totals, "aggregated_features", processing_time=NOW), 1)
    return store_to_training(stored.read(), labeling_options={"noise_std": 0.0})


@query(
    "data_quality_report",
    with_(
        # Both start with the same view of the events; it is needed once.
        RAW + GAPS.removeprefix(EV),
        """SELECT 'raw_data' AS dataset, file, count(*) AS total_records,
             CAST(sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END + CASE WHEN amount IS NULL OR amount IN ('0', '-5', '100001', 'abc', '1.5d') THEN 1 ELSE 0 END) AS BIGINT) AS issues,
             CASE WHEN sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END + CASE WHEN amount IS NULL OR amount IN ('0', '-5', '100001', 'abc', '1.5d') THEN 1 ELSE 0 END) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
           FROM raw GROUP BY file
           UNION ALL SELECT 'feature_data', channel, count(*), CAST(sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END + CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS BIGINT),
             CASE WHEN sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END + CASE WHEN amount IS NULL THEN 1 ELSE 0 END) = 0 THEN 'PASSED' ELSE 'FAILED' END FROM gaps GROUP BY channel
           UNION ALL SELECT 'missing_rates', 'all', 2, CAST(issues AS BIGINT), CASE WHEN issues = 0 THEN 'PASSED' ELSE 'FAILED' END FROM (
             SELECT CASE WHEN avg(CASE WHEN user_id IS NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.1 THEN 1 ELSE 0 END
               + CASE WHEN avg(CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.1 THEN 1 ELSE 0 END AS issues FROM gaps)""",
    ),
)
def quality_report(spark, folder):
    """Raw records by file, features by channel, and missing rates."""
    return data_quality_report(
        raw_text(spark, folder), gaps(spark, folder), "file", "channel", ["user_id", "amount"]
    )
