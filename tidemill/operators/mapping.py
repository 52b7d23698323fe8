"""From feature columns to the ordered input columns of a model.

Training and scoring call the same function, so they cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.config import ModelDefinition
from tidemill.functions.scalars import apply_transform, coerce_numeric


def model_column(df: DataFrame, model: ModelDefinition, column: str) -> Column:
    """Mapped field, else encoded field, else the same name, else 0."""
    kinds = dict(df.dtypes)
    mapping = model.mapping_for(column)
    if mapping is not None:
        if mapping.source not in kinds:
            return F.lit(0)
        return apply_transform(mapping, F.col(mapping.source), kinds[mapping.source])
    if column in kinds:
        return coerce_numeric(F.col(column), kinds[column])
    return F.lit(0)


def has_model_schema(df: DataFrame, model: ModelDefinition) -> bool:
    """All model columns are there, with at most two others."""
    return set(model.columns) <= set(df.columns) and len(df.columns) <= len(model.columns) + 2


def transform_features(
    df: DataFrame,
    model: ModelDefinition,
    keep: tuple[str, ...] = (),
    skip_if_mapped: bool = False,
) -> DataFrame:
    """One projection with exactly the model's columns, after ``keep``.

    ``skip_if_mapped`` leaves frames that already have the schema alone, as
    scoring does.
    """
    if skip_if_mapped and has_model_schema(df, model):
        return df.select(*keep, *model.columns)
    return df.select(*keep, *[model_column(df, model, c).alias(c) for c in model.columns])


def fill_nulls_zero(df: DataFrame) -> DataFrame:
    """Numbers that are null become 0."""
    return df.na.fill(0)
