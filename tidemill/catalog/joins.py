"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.registry import FEAT, NOW, TX, features, log, query, r7, tx, with_
from tidemill.catalog.aggregates import USER_AGGREGATES
from tidemill.config import FRAUD_DETECTOR
from tidemill.operators import joins as J
from tidemill.operators import monitor as M
from tidemill.operators.aggregate import aggregate_users, aggregation_errors
from tidemill.operators.extract import errors_of, extract_features, features_of
from tidemill.catalog.records import DOCS, documents
from tidemill.plans.training import profile_features
from tidemill.session import table
from tidemill.sources import adapters


@query(
    "j_agg_left",
    with_(
        f"{FEAT}, agg AS (SELECT user_id, {USER_AGGREGATES} FROM feat GROUP BY user_id)",
        "SELECT message_id, f.user_id, record_count, avg_amount FROM feat f LEFT JOIN agg a ON f.user_id = a.user_id",
    ),
    digits=9,
)
def j_agg_left(spark, folder):
    """Mapped aggregate columns on every record."""
    rows = features(spark, folder)
    aggregated = aggregate_users(rows, None)
    joined = J.join_aggregates(rows, aggregated.withColumnRenamed("user_id", "key"), FRAUD_DETECTOR)
    return joined.select("message_id", "user_id", "record_count", "avg_amount")


@query(
    "j_agg_left_gaps",
    """SELECT CAST(c_custkey AS VARCHAR) AS message_id, n.n AS record_count, round(n.mean, 9) + 0.0 AS avg_amount
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1) n ON o_custkey = c_custkey""",
    digits=9,
)
def j_agg_left_gaps(spark, folder):
    """Customers as records and their orders as aggregates: who has no order gets nulls."""
    records = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_totalprice").cast("double").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.col("o_orderdate").cast("string").alias("timestamp"),
    )
    aggregated = aggregate_users(orders, None).withColumnRenamed("user_id", "key")
    joined = J.join_aggregates(records, aggregated, FRAUD_DETECTOR)
    return joined.select(F.col("user_id").alias("message_id"), "record_count", "avg_amount")


@query(
    "j_labels_left",
    """SELECT d.doc_id, CAST(coalesce(l.label, 0) AS BIGINT) AS label
       FROM documents d LEFT JOIN (SELECT doc_id, min(toxic) AS label FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
)
def j_labels_left(spark, folder):
    """Every label occurs twice; records must not multiply."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, folder, "documents").select("doc_id")
    return J.join_labels(docs, labels.unionAll(labels), "doc_id")


@query(
    "j_groups_outer",
    """SELECT coalesce(a.key, b.key) AS key, a.orders, b.balance
       FROM (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS orders FROM orders GROUP BY 1) a
       FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS key, round(c_acctbal, 6) + 0.0 AS balance FROM customer) b
       ON a.key = b.key""",
)
def j_groups_outer(spark, folder):
    orders = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    balances = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").alias("balance")
    )
    return J.join_groups([orders, balances])


@query(
    "j_user_profile",
    with_(
        f"{TX}, profile AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 18 + c_custkey % 60 AS age, c_nationkey AS income_bracket, c_custkey % 9 AS transaction_count, round(c_acctbal / 10000, 6) AS location_risk_score FROM customer)",
        f"""SELECT message_id, t.user_id, CAST(coalesce(age, 0) AS BIGINT) AS age, CAST(coalesce(income_bracket, 0) AS BIGINT) AS income_bracket,
             CAST(coalesce(p.transaction_count, 0) AS BIGINT) AS transaction_count,
             {r7('coalesce(location_risk_score, 0.5)')} AS location_risk_score
           FROM tx t LEFT JOIN profile p ON t.user_id = p.user_id""",
    ),
)
def j_user_profile(spark, folder):
    key = F.col("c_custkey")
    profiles = table(spark, folder, "customer").select(
        key.cast("string").alias("user_id"),
        (18 + key % 60).alias("age"),
        F.col("c_nationkey").alias("income_bracket"),
        (key % 9).alias("transaction_count"),
        F.round(F.col("c_acctbal") / 10000, 6).alias("location_risk_score"),
    )
    return profile_features(tx(spark, folder).select("message_id", "user_id"), profiles)


@query(
    "j_prediction_outcome",
    with_(
        """ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
        """SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN user_id % 2 = 0 THEN 'fraud_detector' ELSE 'churn' END AS model_name,
             CAST(CASE WHEN k >= 50 THEN 1 ELSE 0 END AS BIGINT) AS predicted,
             CAST(CASE WHEN k + user_id % 7 >= 52 THEN 1 ELSE 0 END AS BIGINT) AS actual
           FROM ev""",
    ),
)
def j_prediction_outcome(spark, folder):
    """Outcomes beside the predictions of all requests."""
    rows = log(spark, folder)
    outcomes = rows.select("request_id", "actual")
    return M.prediction_outcome(rows.select("request_id", "model_name", "predicted"), outcomes)


@query(
    "j_prediction_outcome_gaps",
    """SELECT CAST(d.doc_id AS VARCHAR) AS request_id, d.lang AS model_name, CAST(d.n_chars > 1000 AS BIGINT) AS predicted, l.actual
       FROM documents d JOIN (SELECT doc_id, CAST(max(quality) AS BIGINT) AS actual FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""",
)
def j_prediction_outcome_gaps(spark, folder):
    """Documents as requests and their labels as outcomes; requests whose outcome is unknown are left out."""
    requests = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.col("lang").alias("model_name"),
        (F.col("n_chars") > 1000).cast("bigint").alias("predicted"),
    )
    outcomes = table(spark, folder, "labels").groupBy(F.col("doc_id").cast("string").alias("request_id")).agg(
        F.max("quality").cast("bigint").alias("actual")
    )
    return M.prediction_outcome(requests, outcomes)


@query(
    "flatten_errors",
    with_(
        DOCS,
        f"""SELECT transform, count(*) AS errors, count(error) AS with_message, count("key") AS with_key FROM (
             SELECT 'FeatureExtraction' AS transform, error, NULL AS "key" FROM docs WHERE error IS NOT NULL
             UNION ALL SELECT 'ValidateFeatures', 'negative amount', NULL FROM docs WHERE error IS NULL AND amount < 0)
           GROUP BY transform""",
    ),
)
def flatten_errors(spark, folder):
    """Errors of three steps with different columns in one table."""
    extracted = extract_features(documents(spark, folder), "value", NOW)
    good = features_of(extracted)
    validation = good.filter("amount < 0").select(
        F.lit("negative amount").alias("error"), F.lit("ValidateFeatures").alias("transform")
    )
    everything = J.union_errors(
        errors_of(extracted, NOW), validation, aggregation_errors(aggregate_users(good, None))
    )
    return everything.groupBy("transform").agg(
        F.count(F.lit(1)).alias("errors"),
        F.count("error").alias("with_message"),
        F.count("key").alias("with_key"),
    )


RUNS = """ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
  runs AS (SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS run_id, event_type AS model_name,
    CAST(user_id AS VARCHAR) AS model_version, CAST(user_id % 3 AS VARCHAR) AS experiment,
    CASE WHEN user_id % 5 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
    CASE WHEN user_id % 10 = 0 THEN 'production' ELSE 'none' END AS deployment_status,
    0.5 + avg(CAST(k AS DOUBLE) / 100) * 0.7 AS accuracy, 0.4 + avg(CAST(k AS DOUBLE) / 100) * 0.8 AS f1_score,
    0.45 + avg(CAST(k AS DOUBLE) / 100) * 0.7 AS "precision", 0.35 + avg(CAST(k AS DOUBLE) / 100) * 0.9 AS recall
  FROM ev GROUP BY user_id, event_type)"""


def runs(spark, folder):
    return adapters.training_runs(table(spark, folder, "events"))


@query(
    "concat_runs",
    with_(
        RUNS,
        """SELECT experiment, count(*) AS "rows", count(accuracy) FILTER (WHERE experiment <> '2') AS with_accuracy,
             count(recall) FILTER (WHERE experiment <> '1') AS with_recall
           FROM runs GROUP BY experiment""",
    ),
)
def concat_runs(spark, folder):
    """Experiments that track different metrics, put together."""
    rows = runs(spark, folder)
    parts = [
        rows.filter("experiment = '0'"),
        rows.filter("experiment = '1'").drop("recall"),
        rows.filter("experiment = '2'").drop("accuracy"),
    ]
    return J.union_errors(*parts).groupBy("experiment").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("accuracy").alias("with_accuracy"),
        F.count("recall").alias("with_recall"),
    )


@query(
    "missing_columns",
    with_(TX, "SELECT count(*) AS \"rows\", 'avg_amount_30d,transaction_count_24h' AS missing FROM tx"),
)
def missing_columns(spark, folder):
    """Schema check only; the row count shows that no data was dropped."""
    rows = features(spark, folder)
    wanted = ["amount", "avg_amount_30d", "hour_of_day", "transaction_count_24h"]
    gone = ",".join(J.missing_columns(rows, wanted))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(gone).alias("missing"))
