"""Ordered operations: deduplication, newest and best rows, top lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.catalog.aggregates import CORRELATED, labelled
from tidemill.catalog.joins import RUNS, runs
from tidemill.catalog.registry import (
    FEAT,
    LABELLED,
    LOG,
    TX,
    features,
    log,
    query,
    r7,
    tx,
    with_,
)
from tidemill.operators import explore as E
from tidemill.operators import joins as J
from tidemill.operators import metrics as Q
from tidemill.operators import monitor as M
from tidemill.operators import training as T
from tidemill.plans.training import assemble_training
from tidemill.operators.aggregate import aggregate_users
from tidemill.session import materialize, work_path


@query(
    "dedup_first",
    with_(
        TX,
        """SELECT id, message_id, timestamp FROM (
             SELECT CASE WHEN k < 33 THEN 'unknown' ELSE CAST(CAST(message_id AS BIGINT) // 3 AS VARCHAR) END AS id, message_id, timestamp,
               row_number() OVER (PARTITION BY CASE WHEN k < 33 THEN 'unknown' ELSE CAST(CAST(message_id AS BIGINT) // 3 AS VARCHAR) END
                 ORDER BY ts, message_id) AS rn FROM tx) WHERE rn = 1""",
    ),
)
def dedup_first(spark, folder):
    """Ids occur several times and one id holds a third of all rows."""
    rows = features(spark, folder).withColumn(
        "id",
        F.when(F.col("account_age_days") < 33, "unknown").otherwise(
            F.floor(F.col("message_id").cast("bigint") / 3).cast("string")
        ),
    )
    return J.dedup_first(rows, "id", ("event_time", "message_id")).select("id", "message_id", "timestamp")


@query("dedup_unset", with_(TX, "SELECT 'unknown' AS id, message_id FROM tx"))
def dedup_unset(spark, folder):
    """When every id is the placeholder, all rows stay."""
    rows = features(spark, folder).withColumn("id", F.lit("unknown"))
    return J.dedup_first(rows, "id", ("event_time", "message_id")).select("id", "message_id")


@query(
    "latest_version",
    with_(
        RUNS,
        f"""SELECT model_name, model_version, {r7('accuracy')} AS accuracy FROM runs
           QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY CAST(model_version AS INTEGER) DESC) = 1""",
    ),
)
def latest_version(spark, folder):
    return Q.latest_version(runs(spark, folder)).select("model_name", "model_version", "accuracy")


@query(
    "best_run",
    with_(
        RUNS,
        f"""SELECT run_id, experiment, model_name, {r7('accuracy')} AS accuracy FROM runs WHERE status = 'FINISHED'
           ORDER BY runs.accuracy DESC, run_id LIMIT 1""",
    ),
)
def best_run(spark, folder):
    return J.best_run(runs(spark, folder), "accuracy").select("run_id", "experiment", "model_name", "accuracy")


@query(
    "best_run_per_experiment",
    with_(
        RUNS,
        f"""SELECT run_id, experiment, {r7('f1_score')} AS f1_score FROM runs WHERE status = 'FINISHED'
           QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY runs.f1_score DESC, run_id) = 1""",
    ),
)
def best_run_per_experiment(spark, folder):
    return J.best_run(runs(spark, folder), "f1_score", ["experiment"]).select("run_id", "experiment", "f1_score")


_ABS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", corr({c}, label) AS c FROM labelled""" for c in (*CORRELATED, "label")
)


@query(
    "topk_corr",
    with_(
        LABELLED,
        f"""SELECT "column", {r7('c')} AS correlation FROM (
             SELECT * FROM ({_ABS}) ORDER BY round(abs(c), 12) DESC, "column" LIMIT 6) WHERE "column" <> 'label'""",
    ),
)
def topk_corr(spark, folder):
    """Six columns by absolute correlation, the label among them, then without it."""
    rows = labelled(spark, folder).select(
        F.round("amount", 6).alias("amount"), *[c for c in CORRELATED if c != "amount"], "label"
    )
    return E.top_correlated(rows)


@query(
    "topk_importance",
    """SELECT CAST(range + 1 AS BIGINT) AS place, TRUE AS is_share, TRUE AS not_above_the_one_before FROM range(8)""",
)
def topk_importance(spark, folder):
    """Most important inputs of a forest fitted on assembled training data."""
    rows = materialize(features(spark, folder), work_path(spark, "features"))
    training = assemble_training(rows, aggregate_users(rows, None), labeling_options={"noise_std": 0.0})
    columns = [c for c in training.columns if c != "label"]
    model = T.fit(training, columns)
    best = T.importances(spark, model, columns)
    order = W.orderBy(F.desc("importance"), "feature")
    return best.select(
        F.row_number().over(order).alias("place"),
        F.col("importance").between(0, 1).alias("is_share"),
        (F.col("importance") <= F.coalesce(F.lag("importance").over(order), F.lit(1.0))).alias("not_above_the_one_before"),
    )


@query(
    "last_n_predictions",
    with_(
        LOG,
        """SELECT request_id, model_name FROM plog
           QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY request_timestamp DESC, request_id DESC) <= 10000""",
    ),
)
def last_n_predictions(spark, folder):
    return M.last_predictions(log(spark, folder)).select("request_id", "model_name")


@query(
    "last_1500_predictions",
    with_(
        LOG,
        """SELECT request_id, model_name FROM plog
           QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY request_timestamp DESC, request_id DESC) <= 1500""",
    ),
)
def last_1500_predictions(spark, folder):
    """A count that cuts rows at every scale."""
    return M.last_predictions(log(spark, folder), 1500).select("request_id", "model_name")


@query(
    "keep_versions",
    with_(
        RUNS,
        """SELECT model_name, model_version FROM runs
           QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY CAST(model_version AS INTEGER) DESC) <= 3""",
    ),
)
def keep_versions(spark, folder):
    return Q.keep_versions(runs(spark, folder), 3).select("model_name", "model_version")


@query(
    "quantile_flag",
    with_(
        f"{FEAT}, cut AS (SELECT quantile_cont(risk_score, 0.75) AS q FROM feat)",
        """SELECT message_id, CAST(CASE WHEN risk_score > q THEN 1 ELSE 0 END AS BIGINT) AS high_risk FROM feat, cut""",
    ),
)
def quantile_flag(spark, folder):
    return E.above_quantile(features(spark, folder).select("message_id", "risk_score"), "risk_score").select(
        "message_id", "high_risk"
    )
