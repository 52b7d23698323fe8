"""Model quality from tables of labels and predictions, and promotion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import ranks
from tidemill.operators.joins import latest_per_key


def ratio(a: Column, b: Column) -> Column:
    """Quotient with 0 for a zero divisor."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, in one pass."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision, recall and F1, weighted by class support.

    The confusion table is the only thing that is shuffled.
    """
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    scored = per_class.select(
        "support",
        "hit",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
    )
    total = F.sum("support")
    return scored.agg(
        ratio(F.sum("hit"), total).alias("accuracy"),
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")],
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", bucket: Column | None = None) -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half.

    Rows combine into one row per distinct score first; the running count of
    negatives below each score is distributed over score buckets.
    """
    points = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    bucket = ranks.unit_bucket(F.col("_score")) if bucket is None else bucket
    below = ranks.running_totals(points, [], bucket, "_score", {"_upto": "_neg"})
    return below.agg(
        F.try_divide(
            F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2.0)),
            F.sum("_pos").cast("double") * F.sum("_neg"),
        ).alias("auc")
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean squared and absolute error, root, and R squared, in one pass."""
    error = F.col(label) - F.col(prediction)
    sums = df.agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(label).alias("variance"),
    )
    return sums.select(
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (1 - F.try_divide(F.col("mse"), F.col("variance"))).alias("r2"),
    )


def latest_version(runs: DataFrame) -> DataFrame:
    """Run with the highest version per model, compared as numbers."""
    return latest_per_key(runs, ["model_name"], [F.col("model_version").cast("int").desc()])


def champion_join(runs: DataFrame) -> DataFrame:
    """Newest version of each model beside the version in production.

    Both sides are one row per model.
    """
    metrics = ("accuracy", "f1_score", "precision", "recall")
    challenger = latest_version(runs).select(
        "model_name",
        F.col("model_version").alias("challenger_version"),
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(f"challenger_{m}") for m in metrics],
    )
    production = runs.filter(F.col("deployment_status") == "production")
    champion = latest_version(production).select(
        "model_name",
        F.col("model_version").alias("champion_version"),
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(f"champion_{m}") for m in metrics],
    )
    return challenger.join(champion, "model_name", "left")


def promotion_gate(runs: DataFrame, min_accuracy: float = 0.80) -> DataFrame:
    """Promote, skip or reject the newest version of each model, with the reason."""
    pair = champion_join(runs)
    accuracy, best = F.col("challenger_accuracy"), F.col("champion_accuracy")
    f1, best_f1 = F.col("challenger_f1_score"), F.col("champion_f1_score")
    below = accuracy < min_accuracy
    first = F.col("champion_version").isNull()
    same = F.col("champion_version") == F.col("challenger_version")
    wins = (accuracy >= best) & (f1 >= best_f1)
    four = "%.4f"
    losses = F.concat_ws(
        ", ",
        F.when(accuracy < best, F.concat(F.lit("accuracy "), F.format_string(four, accuracy), F.lit(" < "), F.format_string(four, best))),
        F.when(f1 < best_f1, F.concat(F.lit("f1_score "), F.format_string(four, f1), F.lit(" < "), F.format_string(four, best_f1))),
    )
    version = F.concat(F.lit("Challenger v"), F.col("challenger_version"))
    return pair.withColumns(
        {
            "decision": F.when(below, "rejected")
            .when(first, "promoted")
            .when(same, "skipped")
            .when(wins, "promoted")
            .otherwise("rejected"),
            "reason": F.when(
                below,
                F.concat(
                    F.lit("Challenger accuracy "),
                    F.format_string(four, accuracy),
                    F.lit(f" below minimum threshold {min_accuracy:.4f}"),
                ),
            )
            .when(first, "First model promoted (no existing champion)")
            .when(same, "Latest version is already the champion")
            .when(wins, F.concat(version, F.lit(" promoted over champion v"), F.col("champion_version")))
            .otherwise(F.concat(version, F.lit(" rejected: "), losses)),
        }
    )


def keep_versions(runs: DataFrame, count: int) -> DataFrame:
    """Newest ``count`` versions per model."""
    return latest_per_key(runs, ["model_name"], [F.col("model_version").cast("int").desc()], count)


# Automatic promotion and retirement limits.
PROMOTION_LIMITS = {
    "accuracy": 0.85,
    "precision": 0.8,
    "recall": 0.8,
    "response_ms": 100.0,
    "requests_per_minute": 1000.0,
}
RETIREMENT_LIMITS = {"accuracy_drop": 0.1, "age_days": 90, "usage_share": 0.01}


def auto_promotion(runs: DataFrame, traffic: DataFrame, limits: dict | None = None) -> DataFrame:
    """Does each version pass quality, speed and throughput limits?

    ``traffic`` has one row per model and version with ``avg_latency_ms``,
    ``requests_per_minute``, ``usage_share`` and ``age_days``.
    """
    limits = limits or PROMOTION_LIMITS
    joined = runs.join(traffic, ["model_name", "model_version"], "left")
    best = F.max("accuracy").over(_by_model())
    return joined.withColumns(
        {
            "promote": F.coalesce(
                (F.col("accuracy") >= limits["accuracy"])
                & (F.col("precision") >= limits["precision"])
                & (F.col("recall") >= limits["recall"])
                & (F.col("avg_latency_ms") <= limits["response_ms"])
                & (F.col("requests_per_minute") >= limits["requests_per_minute"]),
                F.lit(False),
            ),
            "retire": F.coalesce(best - F.col("accuracy") > RETIREMENT_LIMITS["accuracy_drop"], F.lit(False))
            | F.coalesce(F.col("age_days") > RETIREMENT_LIMITS["age_days"], F.lit(False))
            | F.coalesce(F.col("usage_share") < RETIREMENT_LIMITS["usage_share"], F.lit(False)),
        }
    )


def _by_model():
    from pyspark.sql import Window

    # Versions of one model: a handful of registry rows.
    return Window.partitionBy("model_name")


# Canary traffic in percent, step length and required success.
CANARY_START = 5
CANARY_STEP = 10
CANARY_SECONDS = 300
CANARY_SUCCESS = 0.98


def variant(ids: Column, percent: Column | int, seed: int = 0) -> Column:
    """Stable assignment of an id to the canary or the control side."""
    digest = F.md5(F.concat(ids.cast("string"), F.lit(f":{seed}")).cast("binary"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    return F.when(share < percent, "canary").otherwise("control")


def canary_check(log: DataFrame, start: Column, id_column: str = "request_id", time: str = "request_timestamp") -> DataFrame:
    """Success share per variant and five-minute step while traffic ramps up."""
    step = F.floor((F.unix_seconds(time) - F.unix_seconds(start)) / CANARY_SECONDS).cast("bigint")
    percent = F.least(F.lit(CANARY_START) + step * CANARY_STEP, F.lit(100))
    steps = (
        log.withColumns({"step": step, "traffic_percent": percent})
        .withColumn("variant", variant(F.col(id_column), F.col("traffic_percent")))
        .groupBy("step", "traffic_percent", "variant")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg((F.col("status") != "error").cast("int")).alias("success_rate"),
        )
    )
    return steps.withColumn("healthy", F.col("success_rate") >= CANARY_SUCCESS)


def ab_summary(log: DataFrame, percent: int = 50, id_column: str = "user_id") -> DataFrame:
    """Accuracy, time and error share of two even variants."""
    return (
        log.withColumn("variant", variant(F.col(id_column), percent))
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg((F.col("predicted") == F.col("actual")).cast("int")).alias("accuracy"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.avg((F.col("status") == "error").cast("int")).alias("error_rate"),
        )
    )
