"""Jobs for ``spark-submit``: features, assembly, training and evaluation.

    spark-submit tidemill/jobs.py features --input events/ --output features/
    spark-submit tidemill/jobs.py assemble --features features/features --output training --models definitions/
    spark-submit tidemill/jobs.py train --input training.parquet --output model
    spark-submit tidemill/jobs.py evaluate --input training.parquet --model model --output metrics
"""

from __future__ import annotations

import argparse
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tidemill.config import MODELS, ModelDefinition, read_models
from tidemill.operators.aggregate import aggregate_users
from tidemill.operators.metrics import binary_metrics
from tidemill.operators.training import fit, score
from tidemill.plans.features import batch_features
from tidemill.plans.training import assemble_training, write_training_set
from tidemill.session import build_session


def _model(spark: SparkSession, args: argparse.Namespace) -> ModelDefinition:
    models = {**MODELS, **(read_models(spark, args.models) if args.models else {})}
    return models[args.model_name]


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    """JSON lines of events to features and errors."""
    batch_features(spark, args.input, args.output, processing_time=args.processing_time)


def assemble(spark: SparkSession, args: argparse.Namespace) -> None:
    """Feature files to a labelled training table."""
    rows = spark.read.json(args.input)
    options = {"noise_std": args.noise} if args.noise is not None else None
    table = assemble_training(rows, aggregate_users(rows, None), _model(spark, args), labeling_options=options)
    write_training_set(spark, table, args.output, "parquet", _model(spark, args))


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fit a model on a training table and save it."""
    model = _model(spark, args)
    rows = spark.read.parquet(args.input)
    fitted = fit(rows, list(model.columns), args.kind, label=model.target)
    fitted.write().overwrite().save(args.output)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Metrics of a saved model on a labelled table."""
    model = _model(spark, args)
    rows = spark.read.parquet(args.input)
    scored = score(PipelineModel.load(args.model), rows, list(model.columns), [model.target])
    binary_metrics(scored, model.target).write.mode("overwrite").json(args.output)


JOBS = {"features": features, "assemble": assemble, "train": train, "evaluate": evaluate}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input", "--features", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--models", help="folder of model definitions in JSON or YAML")
    parser.add_argument("--model-name", default="fraud_detector")
    parser.add_argument("--model", help="saved model to evaluate")
    parser.add_argument("--kind", default="random_forest")
    parser.add_argument("--noise", type=float, help="spread of the label noise")
    parser.add_argument("--processing-time")
    args = parser.parse_args(arguments)
    JOBS[args.job](spark or build_session(f"tidemill-{args.job}"), args)


if __name__ == "__main__":
    main(sys.argv[1:])
