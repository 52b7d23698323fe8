"""Splits, model fitting, scoring, quality metrics and promotion."""

from __future__ import annotations

from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.sql import functions as F

from tidemill.catalog.joins import RUNS, runs
from tidemill.catalog.registry import FEAT, LABELLED, LOG, crc_values, features, log, query, r7, with_
from tidemill.config import FRAUD_DETECTOR
from tidemill.operators import metrics as Q
from tidemill.operators import ranks
from tidemill.operators import training as T
from tidemill.operators.labeling import rule_based
from tidemill.operators.mapping import transform_features
from tidemill.session import materialize, table, work_path

PAYMENTS = ("credit_card", "debit_card", "digital_wallet", "bank_transfer")
COLUMNS = ["hour_of_day", "day_of_week", "is_weekend", "amount", "merchant_category_encoded", "payment_method_encoded"]


def training_rows(spark, folder):
    """Model inputs with noise-free labels and an id."""
    labelled = rule_based(features(spark, folder), noise_std=0.0)
    return transform_features(labelled, FRAUD_DETECTOR, ("message_id", "label")).select("message_id", "label", *COLUMNS)


def written_rows(spark, folder):
    """Training rows that are extracted once and read from files by every pass."""
    return materialize(training_rows(spark, folder), work_path(spark, "training-rows"))


@query(
    "split",
    with_(
        LABELLED,
        """SELECT label, count(*) AS "rows", CAST(ceil(count(*) * 0.2) AS BIGINT) AS test FROM labelled GROUP BY label""",
    ),
)
def split(spark, folder):
    """The same share of every class."""
    rows = training_rows(spark, folder)
    parts = T.stratified_split(rows.select("message_id", "label"), "label", ["message_id"])
    return parts.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("split") == "test").alias("test")
    )


@query(
    "split_three_way",
    with_(
        LABELLED,
        """SELECT label, count(*) AS "rows", CAST(ceil(count(*) * 0.2) AS BIGINT) AS test,
             CAST(ceil((count(*) - ceil(count(*) * 0.2)) * 0.125) AS BIGINT) AS validation FROM labelled GROUP BY label""",
    ),
)
def split_three_way(spark, folder):
    """Test 20 percent, validation 10 percent of the whole."""
    rows = training_rows(spark, folder)
    parts = T.stratified_split(rows.select("message_id", "label"), "label", ["message_id"], validation=0.1)
    return parts.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.count_if(F.col("split") == "validation").alias("validation"),
    )


@query(
    "class_weight",
    with_(
        LABELLED,
        f"""SELECT label, count(*) AS "rows", {r7('(SELECT count(*) FROM labelled) / 2.0::DOUBLE / count(*)')} AS weight FROM labelled GROUP BY label""",
    ),
)
def class_weight(spark, folder):
    rows = T.with_class_weights(training_rows(spark, folder).select("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight"))


def fit_and_measure(spark, folder, kind, **params):
    """Facts of a model that is fitted on the training rows: how many test rows
    it scored, that its metrics are shares, and that it beats the most frequent
    class."""
    rows = T.stratified_split(written_rows(spark, folder), "label", ["message_id"])
    rows = materialize(rows, work_path(spark, "split"))
    model = T.fit(rows.filter("split = 'train'"), COLUMNS, kind, **params)
    scored = T.score(model, rows.filter("split = 'test'"), COLUMNS, ["message_id", "label"])
    measured = Q.binary_metrics(scored).crossJoin(
        scored.agg(F.count(F.lit(1)).alias("test_rows"), F.avg("label").alias("_positive"))
    )
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1_score")]
    return measured.select(
        "test_rows",
        (shares[0] & shares[1] & shares[2] & shares[3]).alias("metrics_are_shares"),
        (F.col("accuracy") >= F.greatest("_positive", 1 - F.col("_positive"))).alias("beats_majority"),
    )


FITTED = with_(
    LABELLED,
    """SELECT CAST(sum(test) AS BIGINT) AS test_rows, TRUE AS metrics_are_shares, TRUE AS beats_majority
       FROM (SELECT ceil(count(*) * 0.2) AS test FROM labelled GROUP BY label)""",
)


@query("fit_rf", FITTED)
def fit_rf(spark, folder):
    """Scaler and random forest."""
    return fit_and_measure(spark, folder, "random_forest", balanced=True)


@query("fit_logistic", FITTED)
def fit_logistic(spark, folder):
    """Scaler and logistic regression."""
    return fit_and_measure(spark, folder, "logistic_regression")


@query(
    "fit_linear",
    """SELECT 'linear_regression' AS model, count(*) AS "rows", TRUE AS explains_quantity FROM lineitem""",
)
def fit_linear(spark, folder):
    """Linear regression on line prices explains no less than the best single line by quantity."""
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    inputs = ["l_quantity", "l_discount", "l_tax"]
    model = T.fit(lines, inputs, "linear_regression", "regression")
    linear = Q.regression_metrics(T.score(model, lines, inputs, ["label"]))
    alone = lines.agg(F.count(F.lit(1)).alias("rows"), F.corr("l_quantity", "label").alias("_corr"))
    return linear.crossJoin(alone).select(
        F.lit("linear_regression").alias("model"),
        "rows",
        (F.col("r2") >= F.col("_corr") * F.col("_corr") - 1e-6).alias("explains_quantity"),
    )


@query("fit_boost", FITTED)
def fit_boost(spark, folder):
    """Boosted trees with their defaults."""
    return fit_and_measure(spark, folder, "boosted_trees")


@query("tune", "SELECT CAST(range AS BIGINT) AS trial, TRUE AS auc_is_share FROM range(20)")
def tune(spark, folder):
    """Random search over the grid: the published twenty points in five folds."""
    rows = training_rows(spark, folder)
    validator = T.tune(rows, COLUMNS, "random_forest", trials=20, folds=5, parallelism=8)
    results = [(i, 0.5 <= float(v) <= 1) for i, v in enumerate(validator.avgMetrics)]
    return spark.createDataFrame(results, "trial int, auc_is_share boolean")


@query(
    "cross_val",
    with_(LABELLED, "SELECT 'accuracy' AS metric, CAST(5 AS BIGINT) AS folds, TRUE AS beats_majority, TRUE AS folds_agree FROM labelled LIMIT 1"),
)
def cross_val(spark, folder):
    """Accuracy over five folds by hash of the id."""
    evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    rows = training_rows(spark, folder)
    found = T.cross_validate(spark, rows, COLUMNS, ["message_id"], evaluator, "logistic_regression")
    majority = rows.agg(F.greatest(F.avg("label"), 1 - F.avg("label")).alias("_majority"))
    return found.crossJoin(majority).select(
        "metric",
        "folds",
        (F.col("mean") >= F.col("_majority") - F.col("std")).alias("beats_majority"),
        (F.col("std") < 0.1).alias("folds_agree"),
    )


@query(
    "batch_score",
    with_(FEAT, "SELECT message_id, TRUE AS sums_to_one, TRUE AS prediction_is_likeliest FROM feat"),
)
def batch_score(spark, folder):
    """Every row scored with class probabilities."""
    rows = training_rows(spark, folder)
    model = T.fit(rows, COLUMNS)
    first, second = F.col("probabilities")[0], F.col("probabilities")[1]
    return T.score(model, rows, COLUMNS, ["message_id"]).select(
        "message_id",
        (F.abs(first + second - 1) < 1e-9).alias("sums_to_one"),
        (F.when(F.col("prediction") == 1, second - first).otherwise(first - second) >= 0).alias("prediction_is_likeliest"),
    )


@query(
    "score_distinct",
    with_(
        f"{FEAT}, pay(payment_method, code) AS (VALUES {crc_values(PAYMENTS, 10)})",
        """SELECT count(*) AS "rows", count(DISTINCT (hour_of_day, day_of_week, is_weekend, floor(amount / 1000 + 0.5), merchant_category, code)) AS scored,
             count(DISTINCT message_id) AS messages FROM feat JOIN pay USING (payment_method)""",
    ),
)
def score_distinct(spark, folder):
    """Equal inputs are scored once and share the result."""
    coarse = training_rows(spark, folder).withColumn("amount", F.round("amount", -3))
    model = T.fit(coarse, COLUMNS)
    scored = T.score_distinct(model, coarse, COLUMNS, ["message_id"], "fraud_detector", "1")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("cache_key").alias("scored"),
        F.count_distinct("message_id").alias("messages"),
    )


BINARY = """tp AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)"""


@query(
    "binary_metrics",
    with_(
        BINARY,
        f"""SELECT {r7('(tp + tn)::DOUBLE / (tp + fp + fn + tn)')} AS accuracy, {r7('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS "precision",
             {r7('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS recall, {r7('coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)')} AS f1_score FROM tp""",
    ),
)
def binary_metrics(spark, folder):
    return Q.binary_metrics(table(spark, folder, "labels"), "quality", "toxic")


@query(
    "weighted_metrics",
    with_(
        """cells AS (SELECT l_returnflag AS y, CASE WHEN l_discount > 0.05 THEN 'A' WHEN l_tax > 0.04 THEN 'N' ELSE 'R' END AS p FROM lineitem),
           s AS (SELECT y AS cls, count(*)::DOUBLE AS support, count(*) FILTER (WHERE y = p)::DOUBLE AS hit FROM cells GROUP BY y),
           g AS (SELECT p AS cls, count(*)::DOUBLE AS predicted FROM cells GROUP BY p),
           m AS (SELECT support, hit, coalesce(hit / nullif(predicted, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re,
             coalesce(2 * hit / nullif(support + coalesce(predicted, 0), 0), 0) AS f FROM s LEFT JOIN g ON g.cls = s.cls)""",
        f"""SELECT {r7('sum(hit) / sum(support)')} AS accuracy, {r7('sum(pr * support) / sum(support)')} AS "precision",
             {r7('sum(re * support) / sum(support)')} AS recall, {r7('sum(f * support) / sum(support)')} AS f1 FROM m""",
    ),
)
def weighted_metrics(spark, folder):
    """Three classes predicted from discount and tax."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_discount") > 0.05, "A").when(F.col("l_tax") > 0.04, "N").otherwise("R").alias("prediction"),
    )
    return Q.weighted_metrics(rows)


@query(
    "auc",
    with_(
        LABELLED,
        f"""SELECT {r7('(sum(CASE WHEN label = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0)')} AS auc FROM (
             SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM (SELECT label, risk_score AS s FROM labelled)),
             (SELECT sum(label)::DOUBLE AS n1, count(*)::DOUBLE - sum(label) AS n0 FROM labelled) GROUP BY n1, n0""",
    ),
)
def auc(spark, folder):
    """Exact, with average ranks for ties."""
    rows = rule_based(features(spark, folder), noise_std=0.0)
    return Q.roc_auc(rows, "label", "risk_score")


@query(
    "auc_amount",
    with_(
        LABELLED,
        f"""SELECT {r7('(sum(CASE WHEN label = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0)')} AS auc FROM (
             SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM (SELECT label, amount AS s FROM labelled)),
             (SELECT sum(label)::DOUBLE AS n1, count(*)::DOUBLE - sum(label) AS n0 FROM labelled) GROUP BY n1, n0""",
    ),
)
def auc_amount(spark, folder):
    """A score outside [0, 1], bucketed by magnitude."""
    rows = rule_based(features(spark, folder), noise_std=0.0)
    return Q.roc_auc(rows, "label", "amount", ranks.magnitude_bucket(F.col("_score")))


@query(
    "regression_metrics",
    f"""SELECT {r7('avg(e * e)', 4)} AS mse, {r7('sqrt(avg(e * e))', 4)} AS rmse, {r7('avg(abs(e))', 4)} AS mae, {r7('1 - avg(e * e) / var_pop(y)', 4)} AS r2
       FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)""",
    digits=4,
)
def regression_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction")
    )
    return Q.regression_metrics(rows)


PAIR = f"""{RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY CAST(model_version AS INTEGER) DESC) AS rn,
    row_number() OVER (PARTITION BY model_name, deployment_status ORDER BY CAST(model_version AS INTEGER) DESC) AS rd FROM runs),
  pair AS (SELECT c.model_name, c.model_version AS cv, c.accuracy AS ca, c.f1_score AS cf, p.model_version AS pv, p.accuracy AS pa, p.f1_score AS pf
    FROM (SELECT * FROM ranked WHERE rn = 1) c LEFT JOIN (SELECT * FROM ranked WHERE deployment_status = 'production' AND rd = 1) p ON p.model_name = c.model_name)"""


@query(
    "j_champion",
    with_(
        PAIR,
        f"""SELECT model_name, cv AS challenger_version, {r7('ca')} AS challenger_accuracy, {r7('cf')} AS challenger_f1_score,
             pv AS champion_version, {r7('pa')} AS champion_accuracy, {r7('pf')} AS champion_f1_score FROM pair""",
    ),
)
def j_champion(spark, folder):
    return Q.champion_join(runs(spark, folder)).select(
        "model_name",
        "challenger_version",
        "challenger_accuracy",
        "challenger_f1_score",
        "champion_version",
        "champion_accuracy",
        "champion_f1_score",
    )


@query(
    "gate",
    with_(
        PAIR,
        """SELECT model_name, CASE WHEN ca < 0.8 THEN 'rejected' WHEN pv IS NULL THEN 'promoted' WHEN pv = cv THEN 'skipped'
               WHEN ca >= pa AND cf >= pf THEN 'promoted' ELSE 'rejected' END AS decision,
             CASE WHEN ca < 0.8 THEN 'Challenger accuracy ' || printf('%.4f', ca) || ' below minimum threshold 0.8000'
               WHEN pv IS NULL THEN 'First model promoted (no existing champion)' WHEN pv = cv THEN 'Latest version is already the champion'
               WHEN ca >= pa AND cf >= pf THEN 'Challenger v' || cv || ' promoted over champion v' || pv
               ELSE 'Challenger v' || cv || ' rejected: ' || concat_ws(', ', CASE WHEN ca < pa THEN 'accuracy ' || printf('%.4f', ca) || ' < ' || printf('%.4f', pa) END,
                 CASE WHEN cf < pf THEN 'f1_score ' || printf('%.4f', cf) || ' < ' || printf('%.4f', pf) END) END AS reason FROM pair""",
    ),
)
def gate(spark, folder):
    return Q.promotion_gate(runs(spark, folder)).select("model_name", "decision", "reason")


TRAFFIC = f"""{LOG}, traffic AS (SELECT model_name, model_version, avg(latency_ms) AS avg_latency_ms, count(*) / 60.0::DOUBLE AS requests_per_minute,
    count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model_name) AS usage_share, CAST(model_version AS INTEGER) * 40 AS age_days,
    avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
    count(*) FILTER (WHERE predicted = 1 AND actual = 1)::DOUBLE / count(*) FILTER (WHERE predicted = 1) AS precision,
    count(*) FILTER (WHERE predicted = 1 AND actual = 1)::DOUBLE / count(*) FILTER (WHERE actual = 1) AS recall
    FROM plog GROUP BY model_name, model_version)"""


def traffic(spark, folder):
    from pyspark.sql import Window as W

    hit = (F.col("predicted") == 1) & (F.col("actual") == 1)
    rows = log(spark, folder).groupBy("model_name", "model_version").agg(
        F.avg("latency_ms").alias("avg_latency_ms"),
        (F.count(F.lit(1)) / 60.0).alias("requests_per_minute"),
        F.count(F.lit(1)).alias("_n"),
        F.avg((F.col("predicted") == F.col("actual")).cast("int")).alias("accuracy"),
        F.try_divide(F.count_if(hit), F.count_if(F.col("predicted") == 1)).alias("precision"),
        F.try_divide(F.count_if(hit), F.count_if(F.col("actual") == 1)).alias("recall"),
    )
    total = F.sum("_n").over(W.partitionBy("model_name"))
    return rows.withColumns(
        {"usage_share": F.col("_n") / total, "age_days": F.col("model_version").cast("int") * 40}
    ).drop("_n")


@query(
    "auto_promotion_rules",
    with_(
        TRAFFIC,
        f"""SELECT model_name, model_version, coalesce(accuracy >= 0.85 AND "precision" >= 0.8 AND recall >= 0.8 AND avg_latency_ms <= 100 AND requests_per_minute >= 1000, FALSE) AS promote,
             max(accuracy) OVER (PARTITION BY model_name) - accuracy > 0.1 OR age_days > 90 OR usage_share < 0.01 AS retire FROM traffic""",
    ),
)
def auto_promotion_rules(spark, folder):
    """Quality from outcomes, speed and volume from the log."""
    facts = traffic(spark, folder)
    quality = ["accuracy", "precision", "recall"]
    versions = facts.select("model_name", "model_version", *quality)
    checked = Q.auto_promotion(versions, facts.drop(*quality))
    return checked.select("model_name", "model_version", "promote", "retire")


def variant_sql(ids: str, percent: str) -> str:
    return f"CASE WHEN ('0x' || substr(md5({ids} || ':0'), 1, 8))::BIGINT % 100 < {percent} THEN 'canary' ELSE 'control' END"


@query(
    "canary_check",
    with_(
        f"{LOG}, s AS (SELECT *, CAST(floor(epoch(request_timestamp - TIMESTAMP '2024-01-01') / 300) AS BIGINT) AS step FROM plog)",
        f"""SELECT step, traffic_percent, variant, count(*) AS requests, {r7("avg(CASE WHEN status <> 'error' THEN 1.0::DOUBLE ELSE 0 END)")} AS success_rate,
             avg(CASE WHEN status <> 'error' THEN 1.0::DOUBLE ELSE 0 END) >= 0.98 AS healthy
           FROM (SELECT *, least(5 + step * 10, 100) AS traffic_percent, {variant_sql('request_id', 'least(5 + step * 10, 100)')} AS variant FROM s) GROUP BY ALL""",
    ),
)
def canary_check(spark, folder):
    """Success per variant while traffic ramps up."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return Q.canary_check(log(spark, folder), start)


@query(
    "canary_totals",
    with_(
        LOG,
        """SELECT step, least(5 + step * 10, 100) AS traffic_percent, count(*) AS requests
           FROM (SELECT CAST(floor(epoch(request_timestamp - TIMESTAMP '2024-01-01') / 300) AS BIGINT) AS step FROM plog) GROUP BY step""",
    ),
)
def canary_totals(spark, folder):
    """Both variants of a step add up to its requests."""
    checked = canary_check(spark, folder)
    return checked.groupBy("step", "traffic_percent").agg(F.sum("requests").alias("requests"))


@query(
    "ab_summary",
    with_(
        LOG,
        f"""SELECT {variant_sql('user_id', '50')} AS variant, count(*) AS requests, {r7('avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy,
             {r7('avg(latency_ms)')} AS avg_latency_ms, {r7("avg(CASE WHEN status = 'error' THEN 1.0::DOUBLE ELSE 0 END)")} AS error_rate FROM plog GROUP BY 1""",
    ),
)
def ab_summary(spark, folder):
    """Two even variants by user."""
    return Q.ab_summary(log(spark, folder))


@query("auc_evaluator", with_(LABELLED, "SELECT TRUE AS is_share, TRUE AS close_to_evaluator FROM labelled LIMIT 1"))
def auc_evaluator(spark, folder):
    """MLlib's evaluator beside the exact area, for a fitted model."""
    rows = training_rows(spark, folder)
    model = T.fit(rows, COLUMNS, "logistic_regression")
    scored = T.score(model, rows, COLUMNS, ["label"]).select(
        F.col("label").cast("double").alias("label"), F.col("probabilities")[1].alias("score")
    )
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label")
    return Q.roc_auc(scored).select(
        F.col("auc").between(0.5, 1).alias("is_share"),
        (F.abs(F.col("auc") - evaluator.evaluate(scored)) < 0.005).alias("close_to_evaluator"),
    )
