"""One report over all data-quality checks of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quality import missing_rates, null_features, raw_report


def data_quality_report(
    raw: DataFrame,
    features: DataFrame,
    raw_file: str,
    feature_file: str,
    feature_columns: list[str],
    environment: str = "default",
) -> DataFrame:
    """Records, issues and verdict per data set and file."""
    raw_rows = raw_report(raw, raw_file).select(
        F.lit("raw_data").alias("dataset"), F.col(raw_file).alias("file"), "total_records", "issues"
    )
    gaps = null_features(features, [feature_file], feature_columns).groupBy(feature_file).agg(
        F.count(F.lit(1)).alias("issues")
    )
    totals = features.groupBy(feature_file).agg(F.count(F.lit(1)).alias("total_records"))
    feature_rows = totals.join(gaps, feature_file, "left").select(
        F.lit("feature_data").alias("dataset"),
        F.col(feature_file).alias("file"),
        "total_records",
        F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues"),
    )
    rates = missing_rates(features, feature_columns, environment).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(~F.col("ok")).alias("issues")
    ).select(F.lit("missing_rates").alias("dataset"), F.lit("all").alias("file"), "total_records", "issues")
    rows = reduce(DataFrame.unionByName, [raw_rows, feature_rows, rates])
    return rows.withColumn("status", F.when(F.col("issues") == 0, "PASSED").otherwise("FAILED"))
