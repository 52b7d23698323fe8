"""Per-record feature extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.registry import (
    CHANNEL_CASE,
    EV,
    FEAT,
    MERCHANT_CASE,
    NOW,
    TX,
    features,
    query,
    r7,
    tx,
    with_,
)
from tidemill.functions import record as R
from tidemill.operators.extract import (
    NUMBERS,
    errors_of,
    extract_features,
    features_of,
    read_document,
)
from tidemill.plans.training import flatten_profile, prepare_training
from tidemill.session import spread_table, table
from tidemill.sources import adapters

# What the irregular documents should read as, straight from the table.
DOCS = f"""{EV}, docs AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id, k, event_type,
    CASE k % 4 WHEN 0 THEN '+00:00' WHEN 1 THEN '+05:00' WHEN 2 THEN '' ELSE '-03:30' END AS utc_offset,
    CASE k % 4 WHEN 1 THEN 300 WHEN 3 THEN -210 ELSE 0 END AS offset_minutes,
    k % 25 = 7 AS bad_time,
    CASE WHEN k % 25 = 7 THEN TIMESTAMP '{NOW}' ELSE date_trunc('second', ts) END AS wall,
    CASE WHEN k % 20 = 0 THEN 'unknown' WHEN k % 20 = 1 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
    CASE k % 10 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN 0.0::DOUBLE WHEN 4 THEN -(value * 10)
      ELSE value * 10 END AS amount,
    CASE k % 10 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 4 THEN -(value * 10)
      ELSE value * 10 END AS known_amount,
    CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(k AS DOUBLE) / 100 END AS risk_score,
    CASE k % 13 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN 0 ELSE k END AS account_age_days,
    CASE WHEN k % 9 = 0 THEN 0 ELSE k * 20 END AS account_balance,
    {MERCHANT_CASE} AS merchant_category,
    CASE WHEN k % 8 = 0 THEN 'unknown' WHEN k % 8 = 1 THEN NULL ELSE {CHANNEL_CASE} END AS channel,
    CASE WHEN k % 6 = 0 THEN left(rtrim(repeat('long name ', 12)), 100) ELSE 'unknown' END AS city,
    CASE WHEN k % 11 = 0 THEN 'float() argument must be a string or a real number, not ''NoneType'''
      WHEN k % 11 = 1 THEN 'could not convert string to float: ''bad'''
      WHEN k % 13 = 0 THEN 'invalid literal for int() with base 10: ''3.5''' END AS error
  FROM ev)"""


def documents(spark, folder):
    return adapters.raw_documents(spread_table(spark, folder, "events"))


def extracted(spark, folder):
    return extract_features(documents(spark, folder), "value", NOW)


def doc_record(df):
    """Documents with their fields staged for the column builders."""
    staged, record = read_document(df, "value")
    return record.stage(staged, NUMBERS), record


def with_id(df, columns):
    return df.selectExpr("CAST(event_id AS STRING) AS message_id", *R.aliased(columns))


@query(
    "x_unwrap",
    with_(
        DOCS,
        f"""SELECT message_id,
          strftime(wall, '%Y-%m-%dT%H:%M:%S') || CASE WHEN bad_time THEN '+00:00' ELSE utc_offset END AS timestamp,
          wall AS event_wall,
          wall - to_minutes(CASE WHEN bad_time THEN 0 ELSE offset_minutes END) AS event_time,
          strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%S.%f') AS processed_at
        FROM docs WHERE error IS NULL""",
    ),
)
def x_unwrap(spark, folder):
    """Envelope fields; half of the records carry their payload under ``data``."""
    docs = documents(spark, folder)
    wrapped = F.concat(
        F.lit('{"message_id":"'),
        F.col("event_id").cast("string"),
        F.lit('","timestamp":'),
        F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.timestamp", "variant")),
        F.lit(',"data":'),
        F.col("value"),
        F.lit("}"),
    )
    mixed = docs.withColumn("value", F.when(F.col("event_id") % 2 == 0, wrapped).otherwise(F.col("value")))
    rows = features_of(extract_features(mixed, "value", NOW))
    return rows.select("message_id", "timestamp", "event_wall", "event_time", "processed_at")


@query(
    "x_amount",
    with_(
        DOCS,
        f"""SELECT message_id, {r7('amount')} AS amount,
          CASE WHEN amount IS NULL THEN NULL WHEN amount > 0 THEN {r7('ln(1 + amount)')} ELSE 0.0::DOUBLE END AS amount_log,
          amount > 500 AS is_high_amount, {r7('known_amount')} AS amount_rounded
        FROM docs""",
    ),
)
def x_amount(spark, folder):
    """Amount and derivatives for missing, null, textual and negative amounts."""
    df, record = doc_record(documents(spark, folder))
    columns = R.amount_columns()
    columns.pop("amount_category")
    return with_id(df.selectExpr("*", *R.aliased(R.amount_stage(record))), columns)


@query(
    "x_amount_category",
    """SELECT o_orderkey, CASE WHEN amount < 10 THEN 'micro' WHEN amount < 100 THEN 'small'
         WHEN amount < 1000 THEN 'medium' WHEN amount < 10000 THEN 'large' ELSE 'huge' END AS amount_category
       FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice / 1000 WHEN 'O' THEN o_totalprice
         ELSE -o_totalprice END AS amount FROM orders)""",
)
def x_amount_category(spark, folder):
    """Bands over order totals, scaled by status so that every band occurs."""
    total = F.col("o_totalprice")
    amount = (
        F.when(F.col("o_orderstatus") == "F", total / 1000)
        .when(F.col("o_orderstatus") == "O", total)
        .otherwise(-total)
    )
    orders = table(spark, folder, "orders").withColumn("amount", amount)
    return orders.selectExpr("o_orderkey", f"{R.amount_category('amount')} AS amount_category")


@query(
    "x_entity_fields",
    with_(
        DOCS,
        """SELECT message_id, user_id, '  ' || merchant_category || ' ' AS merchant_category,
             'unknown' AS merchant_id, 'unknown' AS merchant_name, 'unknown' AS account_id,
             'unknown' AS transaction_type, 'unknown' AS payment_method, 'USD' AS currency
           FROM docs""",
    ),
)
def x_entity_fields(spark, folder):
    """Identifiers: the default fills a missing key, a null stays null."""
    df, record = doc_record(documents(spark, folder))
    return with_id(df, R.entity_columns(record))


@query(
    "x_generic",
    with_(
        DOCS,
        """SELECT message_id, user_id, merchant_category, channel,
             CASE WHEN k % 6 = 0 THEN city END AS city,
             CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(account_balance AS VARCHAR) END AS account_balance,
             FALSE AS has_location
           FROM (SELECT * REPLACE (
               CASE WHEN k % 20 = 0 THEN NULL ELSE user_id END AS user_id,
               CASE WHEN k % 8 = 0 THEN NULL ELSE channel END AS channel,
               '  ' || merchant_category || ' ' AS merchant_category,
               CASE WHEN k % 6 = 0 THEN repeat('long name ', 12) END AS city) FROM docs)
           WHERE error IS NULL""",
    ),
)
def x_generic(spark, folder):
    """Scalars pass through under their own names; nested values are dropped."""
    rows = features_of(extract_features(documents(spark, folder), "value", NOW, "generic"))
    names = ("user_id", "merchant_category", "channel", "city", "account_balance")
    return rows.select(
        "message_id",
        *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names],
        F.map_contains_key("fields", "location").alias("has_location"),
    )


@query(
    "x_temporal",
    with_(
        DOCS,
        """SELECT message_id, hour(wall) AS hour_of_day, isodow(wall) - 1 AS day_of_week, day(wall) AS day_of_month,
             month(wall) AS month, year(wall) AS year, isodow(wall) >= 6 AS is_weekend,
             hour(wall) BETWEEN 9 AND 17 AS is_business_hours, hour(wall) < 6 OR hour(wall) >= 22 AS is_night,
             quarter(wall) AS quarter, weekofyear(wall) AS week_of_year,
             CAST(epoch(wall) AS BIGINT) - 60 * CASE WHEN bad_time THEN 0 ELSE offset_minutes END AS unix_timestamp
           FROM docs WHERE error IS NULL""",
    ),
)
def x_temporal(spark, folder):
    """Calendar fields of the written time and the epoch of the instant."""
    rows = features_of(extracted(spark, folder))
    return rows.selectExpr("message_id", *R.aliased(R.temporal_columns("event_wall", "event_time")))


@query(
    "x_categorical",
    with_(
        DOCS,
        """SELECT message_id, 'unknown' AS country, 'unknown' AS state,
             CASE WHEN k % 6 = 0 THEN repeat('long name ', 12) ELSE 'unknown' END AS city,
             'unknown' AS zip_code, 'unknown' AS device_type, 'unknown' AS os_type,
             'unknown' AS browser, channel, 'unknown' AS source
           FROM docs""",
    ),
)
def x_categorical(spark, folder):
    """Location, device and channel from the top level; nested places are not read."""
    df, record = doc_record(documents(spark, folder))
    return with_id(df, R.categorical_columns(record))


@query(
    "x_numerical",
    with_(
        DOCS,
        f"""SELECT message_id, {r7('risk_score')} AS risk_score, 0.0::DOUBLE AS fraud_score,
             0.0::DOUBLE AS credit_score, CAST(account_age_days AS BIGINT) AS account_age_days,
             CAST(0 AS BIGINT) AS transaction_count, CAST(account_balance AS DOUBLE) AS account_balance,
             0.0::DOUBLE AS latitude, 0.0::DOUBLE AS longitude, error AS numerical_error
           FROM docs""",
    ),
)
def x_numerical(spark, folder):
    """Numbers with default 0 and the message for the first unreadable one."""
    df, record = doc_record(documents(spark, folder))
    return with_id(df, {**R.numerical_columns(record), "numerical_error": R.numerical_error(record)})


@query(
    "x_derived",
    with_(
        FEAT,
        f"""SELECT message_id,
             {r7('CASE WHEN account_balance > 0 THEN amount / account_balance ELSE 0.0::DOUBLE END', 9)} AS amount_to_balance_ratio,
             {r7('(risk_score + fraud_score) / 2', 9)} AS combined_risk_score, is_unusual_time,
             {r7('transaction_count::DOUBLE / greatest(account_age_days, 1)', 9)} AS avg_transactions_per_day
           FROM feat""",
    ),
    digits=9,
)
def x_derived(spark, folder):
    """Ratios; k = 0 has no balance and tests the guard."""
    return features(spark, folder).selectExpr("message_id", *R.aliased(R.derived_columns()))


@query(
    "x_clean",
    """SELECT CAST(doc_id AS BIGINT) AS doc_id, substr(regexp_replace(regexp_replace(text, '^[\\s\\x{a0}]+', ''), '[\\s\\x{a0}]+$', ''), 1, 100) AS text,
         CASE WHEN n_chars % 3 = 0 THEN 0.0::DOUBLE WHEN n_chars % 3 = 1 THEN 0.0::DOUBLE
           ELSE CAST(n_chars AS DOUBLE) END AS number
       FROM documents""",
)
def x_clean(spark, folder):
    """Whole document texts stripped and cut; NaN and infinity become 0."""
    n = F.col("n_chars")
    number = (
        F.when(n % 3 == 0, F.lit(float("nan"))).when(n % 3 == 1, F.lit(float("inf"))).otherwise(n.cast("double"))
    )
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("text"), number.alias("number")
    )
    return docs.selectExpr("doc_id", f"{R.clean('text', 'string')} AS text", f"{R.clean('number', 'double')} AS number")


@query(
    "x_clean_uncut",
    """SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(regexp_replace(text, '^[\\s\\x{a0}]+', ''), '[\\s\\x{a0}]+$', '') AS text FROM documents""",
)
def x_clean_uncut(spark, folder):
    """The same texts in whole."""
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("text"))
    return docs.selectExpr("doc_id", f"{R.clean('text', 'string', None)} AS text")


@query(
    "x_errors",
    with_(
        DOCS,
        f"""SELECT message_id, error, 'FeatureExtraction' AS transform,
             strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, TRUE AS fits
           FROM docs WHERE error IS NOT NULL""",
    ),
)
def x_errors(spark, folder):
    """Error rows carry the document, cut to a thousand characters."""
    errors = errors_of(extracted(spark, folder), NOW)
    document = F.try_parse_json("element")
    return errors.select(
        F.try_variant_get(document, "$.message_id", "string").alias("message_id"),
        "error",
        "transform",
        "timestamp",
        (F.length("element") <= 1000).alias("fits"),
    )


@query(
    "x_errors_uncut",
    with_(
        DOCS,
        "SELECT message_id, error, CASE WHEN k % 6 = 0 THEN repeat('long name ', 12) END AS city, TRUE AS whole FROM docs WHERE error IS NOT NULL",
    ),
)
def x_errors_uncut(spark, folder):
    """Error rows with the whole document and its texts as they came."""
    docs = documents(spark, folder).select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("given"))
    errors = errors_of(extract_features(documents(spark, folder), "value", NOW, element_chars=None), NOW)
    document = F.try_parse_json("element")
    named = errors.withColumn("message_id", F.try_variant_get(document, "$.message_id", "string"))
    return named.join(docs, F.col("message_id") == F.col("id")).select(
        "message_id",
        "error",
        F.try_variant_get(document, "$.city", "string").alias("city"),
        (F.col("element") == F.col("given")).alias("whole"),
    )


@query(
    "extract_features",
    with_(
        DOCS,
        f"""SELECT message_id, user_id, merchant_category, channel, city, {r7('amount', 9)} AS amount,
             amount > 500 AS is_high_amount, {r7('risk_score', 9)} AS risk_score,
             CAST(account_age_days AS BIGINT) AS account_age_days,
             CASE WHEN known_amount IS NULL THEN NULL WHEN known_amount < 10 THEN 'micro'
               WHEN known_amount < 100 THEN 'small' WHEN known_amount < 1000 THEN 'medium'
               WHEN known_amount < 10000 THEN 'large' ELSE 'huge' END AS amount_category,
             hour(wall) AS hour_of_day, isodow(wall) - 1 AS day_of_week,
             {r7('CASE WHEN account_balance > 0 THEN amount / account_balance ELSE 0.0::DOUBLE END', 9)} AS amount_to_balance_ratio,
             {r7('risk_score / 2', 9)} AS combined_risk_score,
             (hour(wall) < 6 OR hour(wall) > 22) AND isodow(wall) >= 6 AS is_unusual_time
           FROM docs WHERE error IS NULL""",
    ),
    digits=9,
)
def extract_all(spark, folder):
    """All steps in order, over irregular JSON documents."""
    return features_of(extracted(spark, folder)).select(
        "message_id",
        "user_id",
        "merchant_category",
        "channel",
        "city",
        "amount",
        "is_high_amount",
        "risk_score",
        "account_age_days",
        "amount_category",
        "hour_of_day",
        "day_of_week",
        "amount_to_balance_ratio",
        "combined_risk_score",
        "is_unusual_time",
    )


def raw_transactions(spark, folder):
    """Transactions with precomputed features, as raw documents carry them."""
    rows = features(spark, folder)
    return rows.select(
        F.col("message_id").alias("transaction_id"),
        "user_id",
        "timestamp",
        "amount",
        "merchant_category",
        "payment_method",
        F.struct(
            "hour_of_day",
            "day_of_week",
            F.when(F.col("account_age_days") % 5 != 0, F.col("is_weekend")).alias("is_weekend"),
            F.col("transaction_count").cast("int").alias("transaction_count_24h"),
            F.when(F.col("account_age_days") % 3 != 0, F.col("account_balance")).alias("avg_amount_30d"),
        ).alias("features"),
        (F.col("account_age_days") >= 90).cast("int").alias("label"),
    )


PREPARED = """SELECT message_id, hour_of_day, day_of_week,
    CASE WHEN k % 5 <> 0 AND is_weekend THEN 1 ELSE 0 END AS is_weekend,
    transaction_count AS transaction_count_24h,
    CASE WHEN k % 3 <> 0 THEN account_balance ELSE 0.0::DOUBLE END AS avg_amount_30d, amount,
    m.b AS merchant_category_encoded, p.b AS payment_method_encoded,
    CASE WHEN k >= 90 THEN 1 ELSE 0 END AS label
  FROM feat JOIN merchant_codes m ON m.n = merchant_category JOIN payment_codes p ON p.n = payment_method"""


def codes_sql() -> str:
    from tidemill.catalog.registry import crc_values

    merchants = crc_values(adapters.MERCHANTS.values(), 100)
    payments = crc_values(adapters.PAYMENTS, 10)
    return (
        f"merchant_codes(n, b) AS (VALUES {merchants}), payment_codes(n, b) AS (VALUES {payments})"
    )


@query(
    "prep_features",
    with_(
        f"{FEAT}, {codes_sql()}",
        f"""SELECT hour_of_day, day_of_week, CAST(is_weekend AS BIGINT) AS is_weekend, transaction_count_24h,
             {r7('avg_amount_30d')} AS avg_amount_30d, {r7('amount')} AS amount,
             CAST(merchant_category_encoded AS BIGINT) AS merchant_category_encoded,
             CAST(payment_method_encoded AS BIGINT) AS payment_method_encoded, CAST(label AS BIGINT) AS label
           FROM ({PREPARED})""",
    ),
)
def prep_features(spark, folder):
    """Nine training columns from precomputed features."""
    return prepare_training(raw_transactions(spark, folder))


@query(
    "flatten_profile",
    """SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(18 + c_custkey % 60 AS BIGINT) AS age,
         round(c_acctbal, 6) + 0.0 AS income, c_mktsegment AS city, 'N' || c_nationkey AS state, 'US' AS country,
         CAST(c_custkey % 30 AS BIGINT) AS avg_monthly_transactions,
         CAST(c_custkey % 3 AS BIGINT) AS historical_fraud_reports,
         round(CAST(c_custkey % 100 AS DOUBLE) / 100, 6) + 0.0 AS risk_score
       FROM customer""",
)
def flatten_profiles(spark, folder):
    """Customers as nested profile documents, flattened again."""
    key = F.col("c_custkey")
    nested = table(spark, folder, "customer").select(
        key.cast("string").alias("user_id"),
        F.struct((18 + key % 60).cast("int").alias("age"), F.col("c_acctbal").alias("income")).alias("demographics"),
        F.struct(
            F.col("c_mktsegment").alias("city"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("state"),
            F.lit("US").alias("country"),
        ).alias("location"),
        F.struct((key % 30).cast("int").alias("avg_monthly_transactions")).alias("behavior"),
        F.struct(
            (key % 3).cast("int").alias("historical_fraud_reports"), (key % 100 / 100.0).alias("risk_score")
        ).alias("risk_profile"),
    )
    return flatten_profile(nested)
