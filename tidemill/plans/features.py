"""Batch feature job: read, extract, validate, aggregate, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.config import RULE_PRESETS, ValidationRules, WindowSpec
from tidemill.operators.aggregate import aggregate_users, aggregation_errors
from tidemill.operators.extract import errors_of, extract_features, features_of
from tidemill.operators.joins import union_errors
from tidemill.operators.validate import invalid_of, valid_of, validate_features
from tidemill.session import materialize
from tidemill.sinks.files import write_json_lines
from tidemill.sinks.tables import Outputs
from tidemill.sources.files import read_json_lines


@dataclass(frozen=True)
class FeatureSettings:
    """Everything the feature job needs besides its input."""

    rules: ValidationRules = RULE_PRESETS["local"]
    window: WindowSpec | None = WindowSpec()
    domain: str = "transaction"
    processing_time: object = None


def feature_outputs(
    df: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    document: str | None = None,
    staging: str | None = None,
) -> Outputs:
    """Features, aggregates, errors and invalid rows of a batch input.

    With ``staging``, records are extracted and checked once, into files below
    that path, and all four outputs read those. Without it everything is lazy
    and each output extracts again.
    """
    now = settings.processing_time
    extracted = extract_features(df, document, now, settings.domain)
    checked = validate_features(extracted, settings.rules)
    if staging is not None:
        checked = materialize(checked, staging)
    good = features_of(checked)
    valid = valid_of(good)
    aggregated = aggregate_users(valid, settings.window)
    errors = union_errors(errors_of(checked, now), aggregation_errors(aggregated))
    return Outputs(features=valid, errors=errors, invalid=invalid_of(good), aggregated=aggregated)


def batch_features(
    spark: SparkSession, input_path: str, output_path: str, domain: str = "transaction", processing_time=None
) -> None:
    """JSON-line files to feature files; failed records go to an error folder."""
    lines = read_json_lines(spark, input_path)
    extracted = extract_features(lines, "doc", processing_time, domain)
    extracted = materialize(extracted, f"{output_path}/_extracted")
    write_json_lines(features_of(extracted), f"{output_path}/features", "overwrite")
    write_json_lines(errors_of(extracted, processing_time), f"{output_path}/errors", "overwrite")
