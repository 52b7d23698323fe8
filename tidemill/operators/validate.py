"""Validation rules over feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.config import ValidationRules

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")
ERRORS = "validation_errors"


def required_rule(field: str, columns: list[str]) -> Column:
    """Message when a required field is absent or null."""
    message = F.lit(f"Missing required field: {field}")
    return F.when(F.col(field).isNull(), message) if field in columns else message


def range_rule(field: str, low: float, high: float) -> Column:
    """Message when a number lies outside the inclusive range."""
    value = F.col(field)
    return F.when(
        (value < low) | ((value > high) & ~F.isnan(value.cast("double"))),
        F.concat(
            F.lit(f"Field {field} value "),
            value.cast("string"),
            F.lit(f" outside range [{low}, {high}]"),
        ),
    )


def categorical_rule(field: str, allowed: tuple[str, ...]) -> Column:
    """Message when a value is not allowed; null is never allowed."""
    value = F.col(field)
    return F.when(
        value.isNull() | ~value.isin(*allowed),
        F.concat(
            F.lit(f"Field {field} value '"),
            F.coalesce(value.cast("string"), F.lit("None")),
            F.lit(f"' not in allowed values: {list(allowed)}"),
        ),
    )


def validation_errors(df: DataFrame, rules: ValidationRules) -> Column:
    """All messages of a row, in rule order."""
    kinds = dict(df.dtypes)
    checks = [required_rule(f, df.columns) for f in rules.required]
    checks += [
        range_rule(f, low, high)
        for f, (low, high) in rules.ranges.items()
        if kinds.get(f) in NUMERIC
    ]
    checks += [categorical_rule(f, a) for f, a in rules.categories.items() if f in kinds]
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))


def validate_features(df: DataFrame, rules: ValidationRules) -> DataFrame:
    """Add ``validation_errors`` and ``is_valid``; split with the helpers below."""
    # Generated, so that filters on the verdict do not evaluate the rules again.
    marked = df.withColumn("_messages", validation_errors(df, rules))
    checked = marked.withColumn(ERRORS, F.explode(F.array("_messages"))).drop("_messages")
    return checked.withColumn("is_valid", F.size(ERRORS) == 0)


def valid_of(checked: DataFrame) -> DataFrame:
    return checked.filter("is_valid").drop("is_valid", ERRORS)


def invalid_of(checked: DataFrame) -> DataFrame:
    """Rejected rows with their messages and the whole feature row."""
    features = [c for c in checked.columns if c not in ("is_valid", ERRORS)]
    return checked.filter(~F.col("is_valid")).select(
        "is_valid", ERRORS, F.struct(*features).alias("features")
    )
