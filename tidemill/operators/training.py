"""Splits, weights, MLlib models and scoring."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import binned, ranks
from tidemill.session import discard, materialize, work_path


def hash_share(ids: list[str], seed: int = 42) -> Column:
    """Uniform number in [0, 1) from the identity of a row."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]), 11)
    return bits.cast("double") / float(2**53)


def with_class_facts(rows: DataFrame, facts: DataFrame, label: str) -> DataFrame:
    """Add the columns of a per-class table to every row, for any number of classes.

    The facts side is chosen by adaptive execution: a few classes are broadcast
    by their measured size, and a class with many rows is split in a shuffle.
    """
    named = facts.withColumnRenamed(label, "_class")
    return rows.join(named, F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")


def stratified_split(
    df: DataFrame,
    label: str,
    ids: list[str],
    test: float = 0.2,
    validation: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` with the same shares of every class.

    Rows are ranked by a hash of their identity inside each class and the
    first ``ceil(test * n)`` are the test rows. The hash at that rank is found
    with :func:`ranks.order_statistics`, so no class is sorted in one task.
    """
    hashed = df.withColumn("_u", hash_share(ids, seed))
    n = F.col("n")
    in_test = F.ceil(n * test)
    share = validation / (1 - test) if validation else 0.0
    in_both = in_test + F.ceil((n - in_test) * share)
    cuts = ranks.order_statistics(
        hashed,
        [label],
        "_u",
        {"test_cut": in_test - 1, "validation_cut": in_both - 1},
        bucket=ranks.unit_bucket(F.col("_u")),
    )
    split = F.when(F.col("_u") <= F.col("test_cut"), "test")
    if validation:
        split = split.when(F.col("_u") <= F.col("validation_cut"), "validation")
    cut = with_class_facts(hashed, cuts.select(label, "test_cut", "validation_cut"), label)
    return cut.withColumn("split", split.otherwise("train")).drop("_u", "test_cut", "validation_cut")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: ``n / (classes * n_class)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / F.col("rows"))


def with_class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Each row with the weight of its class."""
    facts = class_weights(df, label).select(label, F.col("weight").alias(weight))
    return with_class_facts(df.drop(weight), facts, label)


def estimator(kind: str, task: str = "classification", label: str = "label", **params):
    """MLlib estimator by name with the published defaults.

    ``random_forest``, ``boosted_trees``, ``logistic_regression`` and
    ``linear_regression``.
    """
    classify = task == "classification"
    common = {"featuresCol": "features", "labelCol": label}
    # Default parameters per model kind.
    if kind == "random_forest":
        # Deep trees are not walked from their roots again for each level.
        options = {"numTrees": 100, "seed": 42, "cacheNodeIds": True, **params}
        return (RandomForestClassifier if classify else RandomForestRegressor)(**common, **options)
    if kind == "boosted_trees":
        options = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42, **params}
        return (GBTClassifier if classify else GBTRegressor)(**common, **options)
    if kind == "logistic_regression" and classify:
        return LogisticRegression(**common, **{"maxIter": 1000, **params})
    if kind == "linear_regression" and not classify:
        return LinearRegression(**common, **params)
    raise ValueError(f"no {task} model is called {kind}")


def build_pipeline(columns: list[str], model) -> Pipeline:
    """Assemble, standardise, fit."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="error"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
            model,
        ]
    )


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


#: Rows of a task of a fit. A forest of a hundred trees keeps some 500 bytes of each.
TASK_ROWS = 100_000


@contextmanager
def written_table(df: DataFrame) -> Iterator[DataFrame]:
    """The rows written once."""
    path = work_path(df.sparkSession, "training")
    kept = materialize(df, path)
    try:
        yield kept
    finally:
        discard(df.sparkSession, path)


def even_tasks(kept: DataFrame, least: int = 1) -> DataFrame:
    """Written rows spread evenly over tasks; no less than ``least`` where each has a tenth of the most rows."""
    rows = kept.count()
    parts = max(1, -(-rows // TASK_ROWS), min(least, 10 * rows // TASK_ROWS))
    return kept.repartition(parts) if parts > 1 else kept


@contextmanager
def training_table(df: DataFrame) -> Iterator[DataFrame]:
    """The rows written once, as fits pass over them many times, and spread evenly over tasks."""
    with written_table(df) as kept:
        yield even_tasks(kept)


def fit(
    df: DataFrame,
    columns: list[str],
    kind: str = "random_forest",
    task: str = "classification",
    label: str = "label",
    balanced: bool = False,
    **params,
) -> PipelineModel:
    """Fit one of the model kinds on a training table."""
    rows = as_doubles(df, columns).select(*columns, *_named_columns(params), F.col(label).cast("double").alias(label))
    with written_table(rows) as kept:
        of_cells = kind == "boosted_trees" and task == "classification" and set(params) <= _OF_CELLS
        table = kept if of_cells else even_tasks(kept)  # a few passes need not deal the rows anew
        if balanced:
            table = with_class_weights(table, label)
            params["weightCol"] = "weight"
        if of_cells:
            return _fit_boosted(table, columns, label, params)
        return build_pipeline(columns, estimator(kind, task, label, **params)).fit(table)


#: Parameters of boosted trees that do not ask for single rows, as draws or counts of rows do.
_OF_CELLS = {"maxIter", "maxDepth", "stepSize", "seed", "maxBins", "weightCol", "lossType"}

#: MLlib looks for splits in as many rows as the square of ``maxBins``; the square of more is no integer there.
_MOST_BINS = 46_340


def _fit_boosted(table: DataFrame, columns: list[str], label: str, params: dict) -> PipelineModel:
    """Boosted trees pass over the rows some hundred times, so they are fitted to rows of equal bins and label added up.

    Trees see no more than bins of the features, and half way between the values that stand for two bins, where they
    split, is where these end. The model is that of the single rows, each of which has the weight 1.
    """
    stages = build_pipeline(columns, estimator("boosted_trees", label=label, **params)).getStages()
    head = Pipeline(stages=stages[:2]).fit(table)
    weight = F.col(params["weightCol"]).cast("double") if params.get("weightCol") else F.lit(1.0)
    values = binned.bin_values(table, columns, params.get("maxBins", 32))
    with written_table(binned.cells(table, values, [label], weight)) as cells:
        bins = max(len(v) for v in values.values())
        model = stages[2].setWeightCol("_weight").setMaxBins(min(_MOST_BINS, max(2, bins, math.isqrt(cells.count()) + 1)))
        spread = even_tasks(cells, table.sparkSession.sparkContext.defaultParallelism)
        fitted = model.fit(head.transform(binned.with_values(spread, values)))
    return PipelineModel(stages=[*head.stages, fitted])


def _named_columns(params: dict) -> list[str]:
    """Further columns that an estimator is told to read."""
    return [value for name, value in params.items() if name.endswith("Col") and value]


def score(model: PipelineModel, df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Prediction and class probabilities for every row."""
    scored = model.transform(as_doubles(df, columns))
    out = [F.col("prediction")]
    if "probability" in scored.columns:
        out.append(vector_to_array("probability").alias("probabilities"))
    return scored.select(*keep, *out)


def score_distinct(
    model: PipelineModel,
    df: DataFrame,
    columns: list[str],
    keep: list[str],
    model_name: str,
    model_version: str,
) -> DataFrame:
    """Score each distinct feature row once and share the result.

    The key is the MD5 of the sorted features with the model's name and
    version. Copies combine before the shuffle; adaptive execution splits a
    key with many copies when the results are joined back.
    """
    ordered = F.struct(*[F.col(c).cast("double").alias(c) for c in sorted(columns)])
    key = F.md5(F.concat_ws(":", F.lit(model_name), F.lit(model_version), F.to_json(ordered)))
    keyed = df.withColumn("cache_key", key)
    distinct = keyed.groupBy("cache_key").agg(
        *[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("copies")
    )
    results = score(model, distinct, columns, ["cache_key", "copies"])
    return keyed.select("cache_key", *keep).join(results, "cache_key")


def importances(spark: SparkSession, model: PipelineModel, columns: list[str], top: int = 20) -> DataFrame:
    """Most important features of a tree model: one row per input column."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(columns, values)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


def search_grid(kind: str, model, trials: int, seed: int = 42) -> list[dict]:
    """Random sample of ``trials`` points of a small grid, or the whole grid."""
    builder = ParamGridBuilder()
    # The published search grids, in MLlib's names. 30 is the
    # largest depth there, for none; a node that splits from 2, 5 or 10 rows on
    # leaves at least half of them, rounded up, to one side.
    if kind == "boosted_trees":
        builder.addGrid(model.maxIter, [50, 100, 200])
        builder.addGrid(model.maxDepth, [3, 6, 9])
        builder.addGrid(model.stepSize, [0.01, 0.1, 0.2])
    elif kind == "random_forest":
        builder.addGrid(model.numTrees, [50, 100, 200])
        builder.addGrid(model.maxDepth, [30, 10, 20])
        builder.addGrid(model.minInstancesPerNode, [1, 3, 5])
    else:
        return []
    grid = builder.build()
    return random.Random(seed).sample(grid, min(trials, len(grid)))


def tune(
    df: DataFrame,
    columns: list[str],
    kind: str,
    label: str = "label",
    trials: int = 20,
    folds: int = 5,
    parallelism: int = 4,
):
    """Cross-validated random search by area under the ROC curve.

    Forests of the folds are grown on rows of equal bins added up, and share trees (:func:`binned.search_forests`);
    the best point is fitted to all rows by MLlib. Other kinds, and forests of too many different rows, are
    searched by MLlib alone.
    """
    model = estimator(kind, "classification", label)
    grid = search_grid(kind, model, trials)
    rows = as_doubles(df, columns).select(*columns, F.col(label).cast("double").alias(label))
    validator = CrossValidator(
        estimator=build_pipeline(columns, model),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds,
        seed=42,
        parallelism=parallelism,
    )
    with written_table(rows) as kept:
        found = _forest_areas(kept, columns, label, folds, grid) if kind == "random_forest" else None
        table = even_tasks(kept)
        if found is None:
            return validator.fit(table)
        means = found.mean(axis=1)
        best = validator.getEstimator().fit(table, grid[int(means.argmax())])
        return validator._copyValues(CrossValidatorModel(best, means.tolist(), [], found.std(axis=1).tolist()))


def _forest_areas(table: DataFrame, columns: list[str], label: str, folds: int, grid: list[dict]):
    """Areas of a grid of forests by point and fold; None where their rows are too many or no two classes."""
    values = binned.bin_values(table, columns, 32)
    dealt = table.withColumn("_fold", F.floor(F.rand(42) * folds).cast("int"))
    path = work_path(table.sparkSession, "cells")
    cells = materialize(binned.cells(dealt, values, [label, "_fold"], F.lit(1.0)), path)
    try:
        return binned.search_forests(cells, columns, label, "_fold", folds, [{k.name: v for k, v in p.items()} for p in grid])
    finally:
        discard(table.sparkSession, path)


def fold_id(ids: list[str], folds: int, seed: int = 42) -> Column:
    """Fold number from the identity of a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]), F.lit(folds)).cast("int")


def cross_validate(
    spark: SparkSession,
    df: DataFrame,
    columns: list[str],
    ids: list[str],
    evaluator: Evaluator,
    kind: str = "random_forest",
    task: str = "classification",
    label: str = "label",
    folds: int = 5,
    **params,
) -> DataFrame:
    """Mean and spread of a metric over folds, one row."""
    rows = as_doubles(df, columns).withColumns(
        {label: F.col(label).cast("double"), "_fold": fold_id(ids, folds)}
    )
    model = estimator(kind, task, label, **params)
    validator = CrossValidator(
        estimator=build_pipeline(columns, model),
        estimatorParamMaps=[{}],
        evaluator=evaluator,
        numFolds=folds,
        foldCol="_fold",
    )
    fitted = validator.fit(rows)
    mean, spread = fitted.avgMetrics[0], fitted.stdMetrics[0]
    if math.isnan(mean):
        raise ValueError("a fold has no rows of one class")
    return spark.createDataFrame(
        [(evaluator.getOrDefault("metricName"), folds, float(mean), float(spread))],
        "metric string, folds int, mean double, std double",
    )
