"""Validation rules and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.registry import EV, TX, query, r7, tx, with_
from tidemill.config import RULE_PRESETS, ValidationRules
from tidemill.operators import quality as Q
from tidemill.operators.validate import (
    categorical_rule,
    invalid_of,
    range_rule,
    required_rule,
    valid_of,
    validate_features,
)
from tidemill.session import table

CATEGORIES = ("grocery", "restaurant", "electronics")
# Rows with gaps, derived from k: user 0..4 of 50, amount 5..9 of 50.
GAPS = f"""{TX}, gaps AS (
  SELECT * REPLACE (CASE WHEN k % 50 < 5 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN k % 50 BETWEEN 5 AND 9 THEN NULL ELSE amount END AS amount,
    CASE WHEN k % 50 BETWEEN 10 AND 14 THEN NULL ELSE merchant_category END AS merchant_category) FROM tx)"""


def gaps(spark, folder):
    rows = tx(spark, folder)
    k = F.col("account_age_days") % 50
    return rows.withColumns(
        {
            "user_id": F.when(k >= 5, F.col("user_id")),
            "amount": F.when(~k.between(5, 9), F.col("amount")),
            "merchant_category": F.when(~k.between(10, 14), F.col("merchant_category")),
        }
    )


@query(
    "v_required",
    with_(
        GAPS,
        """SELECT message_id, CASE WHEN user_id IS NULL THEN 'Missing required field: user_id' END AS present_column,
             'Missing required field: absent' AS absent_column FROM gaps""",
    ),
)
def v_required(spark, folder):
    df = gaps(spark, folder)
    return df.select(
        "message_id",
        required_rule("user_id", df.columns).alias("present_column"),
        required_rule("absent", df.columns).alias("absent_column"),
    )


@query(
    "v_range",
    with_(
        GAPS,
        """SELECT message_id, CASE WHEN account_age_days < 10 OR account_age_days > 80
             THEN 'Field account_age_days value ' || account_age_days || ' outside range [10, 80]' END AS error,
             amount < 100 OR amount > 4000 AS amount_outside
           FROM gaps""",
    ),
)
def v_range(spark, folder):
    """Inclusive ranges; a null is not a number and passes."""
    df = gaps(spark, folder)
    amount = F.col("amount")
    return df.select(
        "message_id",
        range_rule("account_age_days", 10, 80).alias("error"),
        F.when(amount.isNotNull(), range_rule("amount", 100, 4000).isNotNull()).alias("amount_outside"),
    )


@query(
    "v_categorical",
    with_(
        GAPS,
        f"""SELECT message_id, CASE WHEN merchant_category IS NULL OR merchant_category NOT IN {CATEGORIES}
             THEN 'Field merchant_category value ''' || coalesce(merchant_category, 'None')
               || ''' not in allowed values: [''grocery'', ''restaurant'', ''electronics'']' END AS error
           FROM gaps""",
    ),
)
def v_categorical(spark, folder):
    return gaps(spark, folder).select("message_id", categorical_rule("merchant_category", CATEGORIES).alias("error"))


@query(
    "validate_features",
    with_(
        GAPS,
        f"""SELECT message_id, concat_ws('|',
               CASE WHEN user_id IS NULL THEN 'Missing required field: user_id' END,
               'Missing required field: city',
               CASE WHEN account_age_days < 10 OR account_age_days > 80 THEN
                 'Field account_age_days value ' || account_age_days || ' outside range [10, 80]' END,
               CASE WHEN merchant_category IS NULL OR merchant_category NOT IN {CATEGORIES}
                 THEN 'Field merchant_category value ''' || coalesce(merchant_category, 'None')
                 || ''' not in allowed values: [''grocery'', ''restaurant'', ''electronics'']' END) AS validation_errors,
             FALSE AS is_valid FROM gaps""",
    ),
)
def validate_all(spark, folder):
    """All messages of a row in rule order; one required column is missing altogether."""
    rules = ValidationRules(
        required=("user_id", "city"),
        ranges={"account_age_days": (10, 80)},
        categories={"merchant_category": CATEGORIES},
    )
    checked = validate_features(gaps(spark, folder), rules)
    return checked.select("message_id", "validation_errors", "is_valid")


@query(
    "validate_split",
    with_(
        GAPS,
        """SELECT CASE WHEN user_id IS NOT NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000
               THEN 'valid' ELSE 'invalid' END AS output, count(*) AS "rows"
           FROM gaps GROUP BY 1""",
    ),
)
def validate_split(spark, folder):
    """The two outputs of one validation pass."""
    rules = ValidationRules(required=("user_id", "amount"), ranges={"amount": (0, 4000)})
    checked = validate_features(gaps(spark, folder), rules)
    sides = [
        valid_of(checked).agg(F.lit("valid").alias("output"), F.count(F.lit(1)).alias("rows")),
        invalid_of(checked).agg(F.lit("invalid").alias("output"), F.count(F.lit(1)).alias("rows")),
    ]
    return sides[0].unionByName(sides[1])


@query(
    "rule_presets",
    with_(
        GAPS,
        """SELECT preset, count(*) AS "rows", count(*) FILTER (WHERE ok) AS valid FROM (
             SELECT 'cloud' AS preset, user_id IS NOT NULL AND amount IS NOT NULL AND timestamp IS NOT NULL
               AND amount BETWEEN 0 AND 100000 AND risk_score BETWEEN 0 AND 1 AS ok FROM gaps
             UNION ALL
             SELECT 'local', user_id IS NOT NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 10000 FROM gaps)
           GROUP BY preset""",
    ),
)
def rule_presets(spark, folder):
    df = gaps(spark, folder)
    frames = [
        validate_features(df, rules).agg(
            F.lit(name).alias("preset"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if("is_valid").alias("valid"),
        )
        for name, rules in RULE_PRESETS.items()
    ]
    return frames[0].unionByName(frames[1])


# Raw text records: one file per user, amounts that are missing, bad or out of range.
RAW = f"""{EV}, raw AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'user-' || user_id AS file,
    CASE WHEN k % 20 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id, CAST(ts AS VARCHAR) AS timestamp,
    CASE k % 10 WHEN 1 THEN NULL WHEN 2 THEN 'abc' WHEN 3 THEN '0' WHEN 4 THEN '-5' WHEN 5 THEN '100001'
      WHEN 6 THEN '1.5d' ELSE '12.5' END AS amount
  FROM ev)"""


def raw_text(spark, folder):
    from tidemill.sources.adapters import with_k

    k = F.col("k")
    return with_k(table(spark, folder, "events")).select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"),
        F.when(k % 20 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.col("ts").cast("string").alias("timestamp"),
        F.when(k % 10 == 1, F.lit(None))
        .when(k % 10 == 2, "abc")
        .when(k % 10 == 3, "0")
        .when(k % 10 == 4, "-5")
        .when(k % 10 == 5, "100001")
        .when(k % 10 == 6, "1.5d")
        .otherwise("12.5")
        .alias("amount"),
    )


ISSUES = """SELECT transaction_id, file, unnest(list_filter([
      CASE WHEN user_id IS NULL THEN 'Missing required field: user_id' END,
      CASE WHEN amount IS NULL THEN 'Missing required field: amount' END,
      CASE WHEN amount IN ('0', '-5', '100001') THEN 'Amount out of valid range: ' || amount END,
      CASE WHEN amount IN ('abc', '1.5d') THEN 'Invalid amount format: ' || amount END],
      lambda x: x IS NOT NULL)) AS issue FROM raw"""


@query("v_raw_report", with_(RAW, ISSUES))
def v_raw_report(spark, folder):
    """One row per issue of a raw record."""
    return Q.raw_issues(raw_text(spark, folder), ["transaction_id", "file"])


@query(
    "v_raw_report_by_file",
    with_(
        f"{RAW}, issues AS ({ISSUES})",
        """SELECT r.file, r.total_records, coalesce(i.issues, 0) AS issues, coalesce(i.issues, 0) = 0 AS validation_passed
           FROM (SELECT file, count(*) AS total_records FROM raw GROUP BY file) r
           LEFT JOIN (SELECT file, count(*) AS issues FROM issues GROUP BY file) i ON r.file = i.file""",
    ),
)
def v_raw_report_by_file(spark, folder):
    return Q.raw_report(raw_text(spark, folder), "file")


def with_nan(spark, folder):
    df = gaps(spark, folder)
    return df.withColumn(
        "risk_score", F.when(F.col("account_age_days") % 40 == 3, F.lit(float("nan"))).otherwise(F.col("risk_score"))
    )


@query(
    "v_null_nan",
    with_(
        GAPS,
        """SELECT message_id, unnest(list_filter([CASE WHEN user_id IS NULL THEN 'user_id' END,
             CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN k % 40 = 3 THEN 'risk_score' END],
             lambda x: x IS NOT NULL)) AS feature FROM gaps""",
    ),
)
def v_null_nan(spark, folder):
    return Q.null_features(with_nan(spark, folder), ["message_id"], ["user_id", "amount", "risk_score"])


@query(
    "v_missing_rate",
    with_(
        GAPS,
        f"""SELECT field, {r7('rate')} AS missing_rate, rate <= 0.1 AS ok FROM (
             SELECT 'user_id' AS field, avg(CASE WHEN user_id IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM gaps
             UNION ALL SELECT 'amount', avg(CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0 END) FROM gaps
             UNION ALL SELECT 'timestamp', avg(CASE WHEN timestamp IS NULL THEN 1.0::DOUBLE ELSE 0 END) FROM gaps)""",
    ),
)
def v_missing_rate(spark, folder):
    return Q.missing_rates(gaps(spark, folder), ["user_id", "amount", "timestamp"])


@query(
    "v_type_range",
    with_(
        RAW,
        """SELECT transaction_id, amount IS NOT NULL AND amount NOT IN ('abc', '1.5d') AS amount_is_float,
             amount IS NOT NULL AND amount IN ('0', '12.5') AS amount_in_type_range,
             amount IS NOT NULL AND amount = '12.5' AS amount_in_range, TRUE AS timestamp_is_iso
           FROM raw""",
    ),
)
def v_type_range(spark, folder):
    return Q.type_ranges(raw_text(spark, folder), ["transaction_id"])


QUARTILES = """WITH b AS (SELECT q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high FROM
  (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents))"""


@query(
    "v_outlier_iqr",
    f"{QUARTILES} SELECT doc_id, coalesce(n_chars < low OR n_chars > high, FALSE) AS is_outlier FROM documents, b",
)
def v_outlier_iqr(spark, folder):
    """Documents whose length is far outside the quartiles."""
    rows = table(spark, folder, "documents").select("doc_id", "n_chars")
    return Q.iqr_outliers(rows, "n_chars").select("doc_id", "is_outlier")


@query(
    "v_outlier_remove",
    f"{QUARTILES} SELECT doc_id, n_chars FROM documents, b WHERE NOT coalesce(n_chars < low OR n_chars > high, FALSE)",
)
def v_outlier_remove(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "n_chars")
    return Q.iqr_outliers(rows, "n_chars", action="remove").select("doc_id", "n_chars")


@query(
    "v_outlier_cap",
    f"{QUARTILES} SELECT doc_id, round(CAST(least(greatest(n_chars, low), high) AS DOUBLE), 7) + 0.0 AS n_chars FROM documents, b",
)
def v_outlier_cap(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "n_chars")
    return Q.iqr_outliers(rows, "n_chars", action="cap").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))


@query(
    "v_lognormal",
    with_(
        TX,
        f"""SELECT CAST(max(n) AS BIGINT) AS n, {r7('max(greatest(abs(upto / n - cdf), abs(cdf - (upto - copies) / n)))')} AS ks_statistic,
             {r7('max(0.886 / sqrt(n))')} AS critical_value,
             max(greatest(abs(upto / n - cdf), abs(cdf - (upto - copies) / n))) <= max(0.886 / sqrt(n)) AS is_lognormal
           FROM (SELECT *, CASE WHEN z >= 0 THEN 1 - poly * exp(-z * z / 2) / 2 ELSE poly * exp(-z * z / 2) / 2 END AS cdf
             FROM (SELECT *, ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t
                 - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t AS poly
               FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t
                 FROM (SELECT x, copies, CAST(n AS DOUBLE) AS n, (x - m) / s AS z,
                     CAST(sum(copies) OVER (ORDER BY x) AS DOUBLE) AS upto
                   FROM (SELECT ln(amount) AS x, count(*) AS copies FROM tx WHERE amount > 0 GROUP BY 1),
                     (SELECT avg(ln(amount)) AS m, stddev_pop(ln(amount)) AS s, count(*) AS n FROM tx WHERE amount > 0)))))""",
    ),
)
def v_lognormal(spark, folder):
    return Q.lognormal_check(tx(spark, folder), "amount")
