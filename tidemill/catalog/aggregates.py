"""Aggregations over users, classes and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.registry import (
    FEAT,
    LABELLED,
    LOG,
    bucket,
    features,
    log,
    query,
    r7,
    tx,
    with_,
)
from tidemill.config import WindowSpec
from tidemill.operators import aggregate as A
from tidemill.operators import explore as E
from tidemill.operators import store as S
from tidemill.operators.labeling import rule_based
from tidemill.session import table

USER_AGGREGATES = f"""min(timestamp) AS window_start, max(timestamp) AS window_end, count(*) AS record_count,
  {r7('sum(amount)', 9)} AS total_amount, {r7('avg(amount)', 9)} AS avg_amount, {r7('stddev_pop(amount)', 9)} AS std_amount,
  {r7('min(amount)', 9)} AS min_amount, {r7('max(amount)', 9)} AS max_amount,
  {r7('quantile_cont(amount, 0.5)', 9)} AS median_amount,
  {r7('avg(risk_score)', 9)} AS avg_risk_score, {r7('max(risk_score)', 9)} AS max_risk_score,
  {r7('avg(fraud_score)', 9)} AS avg_fraud_score, {r7('max(fraud_score)', 9)} AS max_fraud_score,
  count(DISTINCT merchant_category) AS unique_merchants, count(DISTINCT channel) AS unique_channels,
  count(DISTINCT payment_method) AS unique_payment_methods,
  count(*) FILTER (WHERE is_weekend) AS weekend_transactions, count(*) FILTER (WHERE is_night) AS night_transactions,
  count(*) FILTER (WHERE is_business_hours) AS business_hours_transactions,
  {r7('avg(CASE WHEN is_high_amount THEN 1.0::DOUBLE ELSE 0 END)', 9)} AS high_amount_ratio,
  {r7('avg(CASE WHEN is_unusual_time THEN 1.0::DOUBLE ELSE 0 END)', 9)} AS unusual_time_ratio"""


@query(
    "agg_user_window",
    with_(
        FEAT,
        f"""SELECT user_id, {bucket(86400)} AS window_from, {bucket(86400)} + INTERVAL 1 DAY AS window_to,
             {USER_AGGREGATES} FROM feat GROUP BY ALL""",
    ),
    digits=9,
)
def agg_user_window(spark, folder):
    """Per user and day."""
    return A.aggregate_users(features(spark, folder), WindowSpec("fixed", "1 day"))


@query("agg_user_all", with_(FEAT, f"SELECT user_id, {USER_AGGREGATES} FROM feat GROUP BY user_id"), digits=9)
def agg_user_all(spark, folder):
    """Per user over the whole input, as training assembly needs it."""
    return A.aggregate_users(features(spark, folder), None)


@query(
    "agg_distinct",
    with_(
        FEAT,
        """SELECT user_id, count(DISTINCT merchant_category) AS unique_merchants,
             count(DISTINCT CASE WHEN k % 5 = 0 THEN '' ELSE channel END) AS unique_channels,
             count(DISTINCT payment_method) AS unique_payment_methods FROM feat GROUP BY user_id""",
    ),
)
def agg_distinct(spark, folder):
    """A missing value counts as one more."""
    rows = features(spark, folder).withColumn(
        "channel", F.when(F.col("account_age_days") % 5 != 0, F.col("channel"))
    )
    return A.aggregate_users(rows, None).select("user_id", *A.CATEGORY_COUNTS)


@query(
    "agg_flags",
    with_(
        FEAT,
        f"""SELECT user_id, {bucket(86400 * 7)} AS window_from, {bucket(86400 * 7)} + INTERVAL 7 DAY AS window_to,
             count(*) FILTER (WHERE is_weekend) AS weekend_transactions,
             count(*) FILTER (WHERE is_night) AS night_transactions,
             count(*) FILTER (WHERE is_business_hours) AS business_hours_transactions,
             {r7('avg(CASE WHEN is_high_amount THEN 1.0::DOUBLE ELSE 0 END)')} AS high_amount_ratio,
             {r7('avg(CASE WHEN is_unusual_time THEN 1.0::DOUBLE ELSE 0 END)')} AS unusual_time_ratio
           FROM feat GROUP BY ALL""",
    ),
)
def agg_flags(spark, folder):
    return A.aggregate_users(features(spark, folder), WindowSpec("fixed", "7 days")).select(
        "user_id",
        "window",
        "weekend_transactions",
        "night_transactions",
        "business_hours_transactions",
        "high_amount_ratio",
        "unusual_time_ratio",
    )


@query(
    "agg_errors",
    with_(FEAT, "SELECT user_id AS key, count(*) AS feature_count, 'AggregateFeatures' AS transform FROM feat GROUP BY user_id HAVING bool_or(hour_of_day = 3 AND amount > 500)"),
)
def agg_errors(spark, folder):
    """Users with an amount that is not finite: here those of some night hours."""
    infinite = (F.col("hour_of_day") == 3) & (F.col("amount") > 500)
    rows = features(spark, folder).withColumn("amount", F.when(infinite, float("inf")).otherwise(F.col("amount")))
    return A.aggregation_errors(A.aggregate_users(rows, None)).select("key", "feature_count", "transform")


def labelled(spark, folder):
    return rule_based(features(spark, folder), noise_std=0.0)


@query(
    "user_rollup",
    with_(
        LABELLED,
        f"""SELECT user_id, min(timestamp) AS first_seen, count(*) AS transaction_count, {r7('sum(amount)')} AS total_amount,
             {r7('avg(amount)')} AS avg_amount, CAST(sum(label) AS BIGINT) AS fraud_count, {r7('avg(label)')} AS fraud_rate
           FROM labelled GROUP BY user_id""",
    ),
)
def user_rollup(spark, folder):
    return A.user_rollup(labelled(spark, folder))


@query(
    "class_balance",
    with_(
        LABELLED,
        f"""SELECT count(*) AS "rows", CAST(sum(label) AS BIGINT) AS positives, {r7('avg(label)')} AS rate,
             CASE WHEN avg(label) < 0.01 THEN 'very low positive rate' WHEN avg(label) > 0.5 THEN 'very high positive rate'
               ELSE 'ok' END AS warning FROM labelled""",
    ),
)
def class_balance(spark, folder):
    return A.class_balance(labelled(spark, folder))


@query(
    "infer_numeric",
    """SELECT avg(CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) > 0.5 AS a,
         avg(CASE WHEN try_cast(b AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) > 0.5 AS b,
         avg(CASE WHEN try_cast(c AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) > 0.5 AS c
       FROM (SELECT CAST(o_totalprice AS VARCHAR) AS a, o_orderpriority AS b,
         CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS c FROM orders)""",
)
def infer_numeric(spark, folder):
    """Text columns that are numbers more often than not."""
    rows = table(spark, folder, "orders").select(
        F.col("o_totalprice").cast("string").alias("a"),
        F.col("o_orderpriority").alias("b"),
        F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderkey").cast("string")).alias("c"),
    )
    return S.infer_numeric(rows)


@query(
    "label_summary",
    with_(
        LABELLED,
        f"""SELECT merchant_category, count(*) AS total, CAST(sum(label) AS BIGINT) AS fraud, {r7('avg(label)')} AS rate
           FROM labelled GROUP BY merchant_category""",
    ),
)
def label_summary(spark, folder):
    return A.label_summary(labelled(spark, folder))


def sparse_log(spark, folder):
    return log(spark, folder).select("request_id", "status", "latency_ms", "error_type", "status_code")


@query(
    "null_counts",
    with_(
        LOG,
        """SELECT "column", count(*) FILTER (WHERE v IS NULL) AS nulls FROM (
             SELECT 'request_id' AS "column", request_id AS v FROM plog UNION ALL SELECT 'status', status FROM plog
             UNION ALL SELECT 'latency_ms', CAST(latency_ms AS VARCHAR) FROM plog
             UNION ALL SELECT 'error_type', error_type FROM plog
             UNION ALL SELECT 'status_code', CAST(status_code AS VARCHAR) FROM plog) GROUP BY "column" """,
    ),
)
def null_counts(spark, folder):
    return E.null_counts(sparse_log(spark, folder))


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, {r7(f'avg({column})')} AS mean,
      {r7(f'stddev_samp({column})')} AS std, {r7(f'CAST(min({column}) AS DOUBLE)')} AS min,
      {r7(f'quantile_cont({column}, 0.25)')} AS q25, {r7(f'quantile_cont({column}, 0.5)')} AS median,
      {r7(f'quantile_cont({column}, 0.75)')} AS q75, {r7(f'CAST(max({column}) AS DOUBLE)')} AS max FROM lineitem"""


@query(
    "describe",
    " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def describe(spark, folder):
    """Summary with sample deviation and interpolated quartiles."""
    return E.describe(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(
    "duplicates",
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS BIGINT) AS duplicates
       FROM lineitem""",
)
def duplicates(spark, folder):
    return E.duplicate_rows(
        table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    )


@query(
    "group_rate",
    with_(
        LABELLED,
        f"""SELECT 'merchant' AS by, merchant_category AS value, {r7('avg(label)')} AS rate FROM labelled GROUP BY ALL
           UNION ALL SELECT 'hour', CAST(hour_of_day AS VARCHAR), {r7('avg(label)')} FROM labelled GROUP BY ALL""",
    ),
)
def group_rate(spark, folder):
    rows = labelled(spark, folder)
    merchant = A.group_rate(rows, "merchant_category").select(
        F.lit("merchant").alias("by"), F.col("merchant_category").alias("value"), "rate"
    )
    hour = A.group_rate(rows, "hour_of_day").select(
        F.lit("hour").alias("by"), F.col("hour_of_day").cast("string").alias("value"), "rate"
    )
    return merchant.unionByName(hour)


PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r7(f'corr({a}, {b})')} AS correlation FROM lineitem"
        for a in PRICES
        for b in PRICES
    ),
)
def correlation(spark, folder):
    """Pearson matrix of the numeric columns of a table, one pass."""
    return E.correlation_matrix(table(spark, folder, "lineitem"), list(PRICES))


CORRELATED = ("amount", "risk_score", "fraud_score", "account_balance", "hour_of_day", "transaction_count")


@query(
    "label_correlation",
    with_(
        LABELLED,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {r7(f'corr({c}, label)')} AS correlation FROM labelled""" for c in CORRELATED
        ),
    ),
)
def label_correlation(spark, folder):
    return E.label_correlations(labelled(spark, folder), "label", list(CORRELATED))


@query(
    "class_ratio",
    with_(
        LABELLED,
        f"""SELECT {r7('avg(amount) FILTER (WHERE label = 1) / avg(amount) FILTER (WHERE label = 0)')} AS amount_ratio,
             {r7('avg(risk_score) FILTER (WHERE label = 1)')} AS risk_positive,
             {r7('avg(risk_score) FILTER (WHERE label = 0)')} AS risk_negative FROM labelled""",
    ),
)
def class_ratio(spark, folder):
    return A.class_ratio(labelled(spark, folder))


@query(
    "readiness",
    with_(
        LABELLED,
        """SELECT count(*) >= 1000 AS sufficient_data, count(*) FILTER (WHERE amount IS NULL) = 0 AS no_missing_values,
             avg(label) > 0.01 AND avg(label) < 0.5 AS balanced_classes,
             least(stddev_samp(amount), stddev_samp(risk_score), stddev_samp(label)) > 0 AS feature_variation,
             TRUE AS numerical_features FROM labelled""",
    ),
)
def readiness(spark, folder):
    return E.readiness(labelled(spark, folder).select("user_id", "amount", "risk_score", "label"))


PROBABILITY = "least(CASE WHEN amount > 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN hour_of_day < 6 OR hour_of_day > 22 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * risk_score, 1.0::DOUBLE)"


@query(
    "pred_summary",
    with_(
        FEAT,
        f"""SELECT count(*) AS total_transactions, count(*) FILTER (WHERE p > 0.5) AS high_risk_count,
             round(avg(p), 3) AS average_fraud_probability,
             round(avg(CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS high_risk_percentage
           FROM (SELECT {PROBABILITY} AS p FROM feat)""",
    ),
)
def pred_summary(spark, folder):
    from tidemill.operators.labeling import risk_heuristic

    rows = features(spark, folder).withColumn(
        "fraud_probability", risk_heuristic(F.col("amount"), F.col("hour_of_day"), F.col("risk_score"))
    )
    return A.prediction_summary(rows)
