"""Training-set jobs: assembly, preparation of raw files, and store reads."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import FRAUD_DETECTOR, ModelDefinition
from tidemill.functions.scalars import bool_to_int, hash_encode
from tidemill.operators.aggregate import class_balance
from tidemill.operators.joins import (
    dedup_first,
    join_aggregates,
    join_groups,
    left_join_first,
    require_columns,
)
from tidemill.operators.labeling import label_strategy
from tidemill.operators.mapping import fill_nulls_zero, transform_features
from tidemill.operators.store import wide_features
from tidemill.sinks.files import write_training

log = logging.getLogger(__name__)


def assemble_training(
    features: DataFrame,
    aggregated: DataFrame,
    model: ModelDefinition = FRAUD_DETECTOR,
    labeling: str = "rule_based",
    labeling_options: dict | None = None,
    dedup_order: tuple[str, ...] = ("event_time",),
) -> DataFrame:
    """Deduplicate, join, label and map features to a training table, lazily.

    ``aggregated`` must have one row per user; :func:`check_training` verifies
    the result.
    """
    records = features
    if "message_id" in records.columns:
        order = tuple(c for c in dedup_order if c in records.columns) or ("message_id",)
        records = dedup_first(records, "message_id", order)
    joined = join_aggregates(records, aggregated, model)
    options = {"threshold": model.label_threshold} if labeling == "rule_based" else {}
    labelled = label_strategy(labeling)(joined, **{**options, **(labeling_options or {})})
    mapped = transform_features(labelled, model, keep=("label",)).withColumnRenamed("label", model.target)
    table = fill_nulls_zero(mapped).select(*model.columns, model.target)
    return require_columns(table, [*model.columns, model.target])


def check_training(spark: SparkSession, path: str, model: ModelDefinition = FRAUD_DETECTOR) -> dict:
    """Row count and class balance of a written table; an empty one is an error."""
    balance = class_balance(spark.read.parquet(path), model.target).first().asDict()
    if balance["rows"] == 0:
        raise ValueError(f"no training rows at {path}")
    if balance["warning"] != "ok":
        log.warning("%s: %.2f%%", balance["warning"], 100 * balance["rate"])
    return balance


def write_training_set(
    spark: SparkSession, table: DataFrame, path: str, kind: str = "csv", model: ModelDefinition = FRAUD_DETECTOR
) -> dict:
    """Write a training table and check what was written."""
    return check_training(spark, write_training(table, path, kind)[-1], model)


def prepare_training(raw: DataFrame) -> DataFrame:
    """Raw transactions with precomputed features to the nine training columns."""
    inside = F.col("features")
    return raw.select(
        F.coalesce(inside["hour_of_day"], F.lit(0)).alias("hour_of_day"),
        F.coalesce(inside["day_of_week"], F.lit(0)).alias("day_of_week"),
        bool_to_int(inside["is_weekend"], "boolean").alias("is_weekend"),
        F.coalesce(inside["transaction_count_24h"], F.lit(0)).alias("transaction_count_24h"),
        F.coalesce(inside["avg_amount_30d"], F.lit(0.0)).alias("avg_amount_30d"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        hash_encode(F.coalesce("merchant_category", F.lit("unknown")), 100).alias("merchant_category_encoded"),
        hash_encode(F.coalesce("payment_method", F.lit("unknown")), 10).alias("payment_method_encoded"),
        F.coalesce("label", F.lit(0)).alias("label"),
    )


# Store features that are text rather than numbers.
TEXT_FEATURES = ("merchant_category", "payment_method", "is_weekend")


def store_frames(store: DataFrame, model: ModelDefinition = FRAUD_DETECTOR) -> tuple[DataFrame, DataFrame]:
    """Per-record group and the outer join of all other groups, from the store."""
    first, *rest = model.store_schema
    records = wide_features(
        store,
        first,
        list(model.store_schema[first]),
        numeric=[n for n in model.store_schema[first] if n not in TEXT_FEATURES],
    )
    groups = [wide_features(store, g, list(model.store_schema[g]), key="key") for g in rest]
    return records, join_groups(groups)


def store_to_training(
    store: DataFrame, model: ModelDefinition = FRAUD_DETECTOR, labeling_options: dict | None = None
) -> DataFrame:
    """Training table from the store, groups joined by entity."""
    records, aggregated = store_frames(store, model)
    return assemble_training(records, aggregated, model, "rule_based", labeling_options)


def profile_features(transactions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Transactions with user facts; a user without a profile gets defaults."""
    # Default per profile field.
    defaults = {"age": 0, "income_bracket": 0, "transaction_count": 0, "location_risk_score": 0.5}
    return left_join_first(transactions, profiles, "user_id", defaults)


def flatten_profile(users: DataFrame) -> DataFrame:
    """Nested user documents to flat columns."""
    return users.select(
        "user_id",
        "demographics.*",
        F.col("location.city").alias("city"),
        F.col("location.state").alias("state"),
        F.col("location.country").alias("country"),
        F.col("behavior.avg_monthly_transactions").alias("avg_monthly_transactions"),
        "risk_profile.*",
    )
