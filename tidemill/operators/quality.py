"""Data-quality checks and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.record import wall_clock
from tidemill.config import MAX_MISSING_RATE
from tidemill.functions.payload import text_to_double
from tidemill.operators import ranks

# Fields every raw record must have, and the valid amounts.
RAW_REQUIRED = ("transaction_id", "user_id", "timestamp", "amount")
RAW_AMOUNT = (0.0, 100000.0)


def raw_issues(df: DataFrame, keep: list[str], required: tuple[str, ...] = RAW_REQUIRED) -> DataFrame:
    """One row per issue of a raw record whose fields are text.

    ``keep`` identifies the record and its file.
    """
    checks = [
        F.when(F.col(f).isNull(), F.lit(f"Missing required field: {f}"))
        if f in df.columns
        else F.lit(f"Missing required field: {f}")
        for f in required
    ]
    amount = text_to_double(F.col("amount"))
    given = F.col("amount").isNotNull()
    checks.append(
        F.when(
            given & ((amount <= RAW_AMOUNT[0]) | (amount > RAW_AMOUNT[1])),
            F.concat(F.lit("Amount out of valid range: "), F.col("amount")),
        )
    )
    checks.append(
        F.when(given & amount.isNull(), F.concat(F.lit("Invalid amount format: "), F.col("amount")))
    )
    return df.select(*keep, F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def raw_report(df: DataFrame, file: str, required: tuple[str, ...] = RAW_REQUIRED) -> DataFrame:
    """Records, issues and verdict per file."""
    marked = df.withColumn("_n", F.lit(1))
    issues = raw_issues(df, [file], required).groupBy(file).agg(F.count(F.lit(1)).alias("issues"))
    totals = marked.groupBy(file).agg(F.count(F.lit(1)).alias("total_records"))
    return (
        totals.join(issues, file, "left")
        .withColumn("issues", F.coalesce("issues", F.lit(0)).cast("bigint"))
        .withColumn("validation_passed", F.col("issues") == 0)
    )


def null_features(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """One row per feature of a record that is null or NaN."""
    kinds = dict(df.dtypes)

    def gap(name: str) -> Column:
        column = F.col(name)
        if kinds[name] in ("double", "float"):
            return column.isNull() | F.isnan(column)
        return column.isNull()

    names = F.array_compact(F.array(*[F.when(gap(f), F.lit(f)) for f in features]))
    return df.select(*keep, F.explode(names).alias("feature"))


def missing_rates(df: DataFrame, fields: list[str], environment: str = "default") -> DataFrame:
    """Share of nulls per field and whether it is tolerable, in one pass."""
    limit = MAX_MISSING_RATE[environment]
    rates = df.agg(*[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in fields])
    return rates.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing_rate")) for f in fields])
        ).alias("r")
    ).select("r.field", "r.missing_rate", (F.col("r.missing_rate") <= limit).alias("ok"))


# Types and ranges of the configured fields.
TYPE_RANGES = {"amount": (0.0, 100000.0), "age": (13.0, 120.0)}
STRICT_AMOUNT = (0.01, 50000.0)


def type_ranges(df: DataFrame, keep: list[str]) -> DataFrame:
    """Verdict per record on text fields: readable, and inside the ranges."""
    amount = text_to_double(F.col("amount"))
    columns = {
        "amount_is_float": amount.isNotNull(),
        "amount_in_type_range": F.coalesce(amount.between(*TYPE_RANGES["amount"]), F.lit(False)),
        "amount_in_range": F.coalesce(amount.between(*STRICT_AMOUNT), F.lit(False)),
        "timestamp_is_iso": F.expr(wall_clock("timestamp")).isNotNull(),
    }
    if "age" in df.columns:
        age = text_to_double(F.col("age").cast("string"))
        columns["age_in_range"] = F.coalesce(age.between(*TYPE_RANGES["age"]), F.lit(False))
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def iqr_outliers(
    df: DataFrame, value: str, threshold: float = 3.0, action: str = "flag"
) -> DataFrame:
    """Flag, remove or cap values far outside the quartiles.

    The quartiles are exact and come in as a scalar subquery.
    """
    stats = ranks.quantiles(df, [], value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    bounds = stats.select(
        F.struct(
            (F.col("q1") - threshold * spread).alias("low"),
            (F.col("q3") + threshold * spread).alias("high"),
        )
    ).scalar()
    marked = df.withColumn("_bounds", bounds)
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    outside = F.coalesce((F.col(value) < low) | (F.col(value) > high), F.lit(False))
    if action == "remove":
        return marked.filter(~outside).drop("_bounds")
    if action == "cap":
        return marked.withColumn(value, F.least(F.greatest(F.col(value), low), high)).drop("_bounds")
    return marked.withColumn("is_outlier", outside).drop("_bounds")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function.

    Polynomial approximation of the error function, formula 7.1.26 of
    Abramowitz and Stegun; the absolute error is below 1.5e-7.
    """
    # Coefficients of the published formula.
    p = 0.3275911
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + p * x)
    poly = reduce(lambda acc, c: (acc + c) * t, reversed(a), F.lit(0.0))
    tail = poly * F.exp(-x * x)
    return F.when(z >= 0, 1.0 - tail / 2.0).otherwise(tail / 2.0)


def lognormal_check(df: DataFrame, value: str) -> DataFrame:
    """Distance of ``ln(value)`` from the normal fitted to it, at level 0.05.

    One row per distinct value, running counts spread over value buckets. Mean
    and deviation are estimated from the data, hence Lilliefors' critical
    value ``0.886 / sqrt(n)``.
    """
    logs = df.filter(F.col(value) > 0).select(F.log(value).alias("_x"))
    points = logs.groupBy("_x").agg(F.count(F.lit(1)).alias("_copies"))
    facts = points.agg(
        F.sum("_copies").alias("n"),
        (F.sum(F.col("_x") * F.col("_copies")) / F.sum("_copies")).alias("mean"),
    )
    mean = facts.select("mean").scalar()
    centred = points.withColumn("_d", F.col("_x") - mean)
    spread = centred.agg(
        F.struct(
            F.sum("_copies").alias("n"),
            F.sqrt(F.sum(F.col("_d") * F.col("_d") * F.col("_copies")) / F.sum("_copies")).alias("std"),
        )
    ).scalar()
    ranked = ranks.running_totals(
        centred, [], ranks.magnitude_bucket(F.col("_x")), "_x", {"_upto": "_copies"}
    ).withColumn("_f", spread)
    n = F.col("_f.n")
    fitted = normal_cdf(F.col("_d") / F.col("_f.std"))
    distance = F.greatest(
        F.abs(F.col("_upto") / n - fitted),
        F.abs(fitted - (F.col("_upto") - F.col("_copies")) / n),
    )
    return ranked.agg(F.max(n).alias("n"), F.max(distance).alias("ks_statistic")).withColumns(
        {
            "critical_value": 0.886 / F.sqrt("n"),
            "is_lognormal": F.col("ks_statistic") <= 0.886 / F.sqrt("n"),
        }
    )
