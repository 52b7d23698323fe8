"""Registration of queries and the shared pieces of their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.extract import extract_features, features_of
from tidemill.session import spread_table, table
from tidemill.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A fixed processing time keeps results repeatable.
NOW = "2024-02-01 00:00:00"


def query(name: str, sql: str | None = None, digits: int = 7):
    """Register a query; its result is brought to plain comparable types.

    ``digits`` is chosen so that no value of the supplied tables is a tie.
    """

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(build(spark, folder), digits)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def present(df: DataFrame, digits: int = 7) -> DataFrame:
    """Whole numbers as BIGINT, decimals rounded, window structs as two times."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            columns.append(column.cast("bigint").alias(name))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            columns.append((F.round(column.cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind == "timestamp":
            columns.append(column.cast("timestamp_ntz").alias(name))
        elif kind == "date":
            columns.append(column.cast("string").alias(name))
        elif kind == "array<string>":
            columns.append(F.array_join(column, "|").alias(name))
        elif kind == "array<double>":
            rounded = F.transform(column, lambda v: F.round(v, digits).cast("string"))
            columns.append(F.array_join(rounded, "|").alias(name))
        elif kind.startswith("struct<start:timestamp") and name in ("window", "session_window"):
            columns.append(column["start"].cast("timestamp_ntz").alias("window_from"))
            columns.append(column["end"].cast("timestamp_ntz").alias("window_to"))
        elif kind == "variant" or kind.startswith(("map<", "struct<", "array<")):
            columns.append(F.to_json(column).alias(name))
        else:
            columns.append(column.alias(name))
    return df.select(*columns)


def tx(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.transactions(spread_table(spark, folder, "events"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return features_of(extract_features(tx(spark, folder), processing_time=NOW))


def log(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.prediction_log(table(spark, folder, "events"))


def crc_values(names, modulo: int) -> str:
    """SQL rows (name, bucket) computed with zlib, independently of Spark."""
    return ", ".join(f"('{n}', {zlib.crc32(n.encode()) % modulo})" for n in names)


def r7(expression: str, digits: int = 7) -> str:
    return f"round({expression}, {digits}) + 0.0"


EV = "ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"
MERCHANT_CASE = (
    "CASE event_type WHEN 'signup' THEN 'grocery' WHEN 'view' THEN 'restaurant' "
    "WHEN 'click' THEN 'electronics' WHEN 'purchase' THEN 'jewelry' WHEN 'error' THEN 'cash_advance' END"
)
PAYMENT_CASE = (
    "CASE k % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' "
    "WHEN 2 THEN 'digital_wallet' ELSE 'bank_transfer' END"
)
CHANNEL_CASE = "CASE k % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'store' END"
TX = f"""{EV}, tx AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id, CAST(user_id AS VARCHAR) AS user_id, ts, k, event_type,
    replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') AS timestamp,
    value * 10 AS amount, {MERCHANT_CASE} AS merchant_category, {PAYMENT_CASE} AS payment_method,
    {CHANNEL_CASE} AS channel, CAST(k AS DOUBLE) / 100 AS risk_score,
    CAST(99 - k AS DOUBLE) / 100 AS fraud_score, CAST(k * 20 AS DOUBLE) AS account_balance,
    CAST(k AS BIGINT) AS account_age_days, CAST(k % 7 AS BIGINT) AS transaction_count
  FROM ev)"""
FEAT = f"""{TX}, feat AS (
  SELECT *, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, isodow(ts) >= 6 AS is_weekend,
    hour(ts) BETWEEN 9 AND 17 AS is_business_hours, hour(ts) < 6 OR hour(ts) >= 22 AS is_night,
    amount > 500 AS is_high_amount,
    (hour(ts) < 6 OR hour(ts) > 22) AND isodow(ts) >= 6 AS is_unusual_time
  FROM tx)"""
RISK = """least(
      CASE merchant_category WHEN 'grocery' THEN 0.01::DOUBLE WHEN 'restaurant' THEN 0.03::DOUBLE
        WHEN 'electronics' THEN 0.08::DOUBLE WHEN 'jewelry' THEN 0.15::DOUBLE
        WHEN 'cash_advance' THEN 0.25::DOUBLE ELSE 0.03::DOUBLE END
      + CASE WHEN hour_of_day < 6 OR hour_of_day >= 22 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN amount > 1000 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN merchant_category IN ('jewelry', 'cash_advance') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN is_weekend AND merchant_category = 'cash_advance' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)"""
# Noise-free rule labels over the features.
LABELLED = f"""{FEAT}, labelled AS (
  SELECT *, CASE WHEN greatest({RISK}, 0.0::DOUBLE) >= 0.65::DOUBLE THEN 1 ELSE 0 END AS label
  FROM feat)"""
LOG = f"""{EV}, plog AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id,
    CASE WHEN user_id % 2 = 0 THEN 'fraud_detector' ELSE 'churn' END AS model_name,
    CAST(1 + user_id % 3 AS VARCHAR) AS model_version, ts AS request_timestamp,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'cache_hit' ELSE 'success' END AS status,
    CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value * 2 END AS latency_ms,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 422 END ELSE 200 END AS status_code,
    CASE WHEN event_type = 'error' THEN
      CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'validation' ELSE 'model' END END AS error_type,
    CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'store' WHEN 2 THEN 'loader' ELSE 'stream' END AS component,
    CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN k >= 50 THEN 1 ELSE 0 END AS predicted,
    CASE WHEN k + user_id % 7 >= 52 THEN 1 ELSE 0 END AS actual, value * 10 AS amount
  FROM ev)"""


def bucket(seconds: int, column: str = "ts") -> str:
    """Start of an epoch-aligned window."""
    return f"time_bucket(INTERVAL '{seconds} seconds', {column}, TIMESTAMP '1970-01-01')"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"
