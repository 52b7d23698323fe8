"""Table-level exploration: nulls, duplicates, spread and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import ranks
from tidemill.operators.timeframes import row_positions

NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, kind in df.dtypes if kind in NUMBERS]


def _long(names: list[str], **columns) -> Column:
    """An array of one struct per column name, ready to explode."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("column"), *[make(n).alias(alias) for alias, make in columns.items()])
            for n in names
        ]
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(F.explode(_long(df.columns, nulls=F.col)).alias("r")).select("r.*")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    columns = columns or numeric_columns(df)
    basic = df.agg(
        *[
            f(c).alias(f"{c}__{name}")
            for c in columns
            for name, f in (
                ("count", F.count),
                ("mean", F.avg),
                ("std", F.stddev_samp),
                ("min", F.min),
                ("max", F.max),
            )
        ]
    )
    wide = basic.select(
        F.explode(
            _long(
                columns,
                count=lambda c: F.col(f"{c}__count"),
                mean=lambda c: F.col(f"{c}__mean").cast("double"),
                std=lambda c: F.col(f"{c}__std"),
                min=lambda c: F.col(f"{c}__min").cast("double"),
                max=lambda c: F.col(f"{c}__max").cast("double"),
            )
        ).alias("r")
    ).select("r.*")
    values = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("v")
    ).select("v.*")
    quartiles = ranks.quantiles(
        values, ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}
    ).drop("n")
    return wide.join(quartiles, "column", "left")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in every column."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def label_correlations(df: DataFrame, label: str = "label", columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each numeric column with the label, in one pass."""
    columns = columns or numeric_columns(df)
    y = F.col(label).cast("double")
    row = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in columns])
    return row.select(F.explode(_long(columns, correlation=F.col)).alias("r")).select("r.*")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, in one pass."""
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs]
    )
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("correlation"))
                    for a, b in pairs
                ]
            )
        ).alias("r")
    ).select("r.*")


def top_correlated(df: DataFrame, label: str = "label", count: int = 6) -> DataFrame:
    """Columns with the largest absolute correlation.

    As published, ``count`` columns are taken first and the label, which always
    leads with 1, is removed from them afterwards.
    """
    ranked = label_correlations(df, label).orderBy(
        F.abs("correlation").desc_nulls_last(), F.col("column")
    )
    return ranked.limit(count).filter(F.col("column") != label)


def above_quantile(df: DataFrame, value: str, share: float = 0.75, name: str = "high_risk") -> DataFrame:
    """1 where a value lies above an exact quantile of its column."""
    cut = ranks.quantiles(df, [], value, {"cut": share}).select("cut").scalar()
    return df.withColumn("_cut", cut).withColumn(name, (F.col(value) > F.col("_cut")).cast("int")).drop("_cut")


def readiness(df: DataFrame, label: str = "label") -> DataFrame:
    """Checklist before training, one row."""
    numbers = numeric_columns(df)
    spread = [F.stddev_samp(c) for c in numbers]
    lowest = F.least(*spread) if len(spread) > 1 else spread[0]
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    rate = F.avg(F.col(label).cast("double"))
    return df.agg(
        (F.count(F.lit(1)) >= 1000).alias("sufficient_data"),
        (sum(nulls[1:], nulls[0]) == 0).alias("no_missing_values"),
        ((rate > 0.01) & (rate < 0.5)).alias("balanced_classes"),
        (lowest > 0).alias("feature_variation"),
        F.lit(len(numbers) >= 3).alias("numerical_features"),
    )


def smoothed_risk(
    df: DataFrame, keys: list[str], label: str = "label", weight: float = 20.0
) -> DataFrame:
    """Risk of a location: its positive rate, drawn to the overall rate when rare.

    No formula is published for this score; the definition is ours.
    """
    overall = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("double")).alias("_positive")
    ).select(
        *keys, "rows", ((F.col("_positive") + weight * overall) / (F.col("rows") + weight)).alias("location_risk_score")
    )


def label_codes(df: DataFrame, name: str) -> DataFrame:
    """Add ``<name>_code``: the place of a value among the sorted distinct values.

    Values are cut into ranges at splitters that Spark samples from them, so
    values with a common beginning are spread as well; places are counted within
    ranges and then across them. A null has no code.
    """
    values = df.select(F.col(name).alias("_value")).filter(F.col("_value").isNotNull()).distinct()
    placed = row_positions(values.withColumn("_all", F.lit(0)), "_all", ["_value"])
    codes = placed.select("_value", (F.col("_position") - 1).cast("double").alias(f"{name}_code"))
    return df.join(codes, F.col(name) == F.col("_value"), "left").drop("_value")


def frequent_categories(df: DataFrame, name: str, limit: int = 50) -> list[str]:
    """The ``limit`` most frequent values, ties by value: what a one-hot is fitted on."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_rows"))
    return [row[0] for row in counts.orderBy(F.desc("_rows"), name).limit(limit).collect()]
