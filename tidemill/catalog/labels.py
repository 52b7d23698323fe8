"""Label strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.aggregates import PROBABILITY
from tidemill.catalog.registry import FEAT, LABELLED, RISK, features, query, r7, with_
from tidemill.operators.labeling import hash_normal, label_strategy, risk_heuristic
from tidemill.session import table


@query("label_rule", with_(LABELLED, "SELECT message_id, CAST(label AS BIGINT) AS label FROM labelled"))
def label_rule(spark, folder):
    """Rule without noise."""
    return label_strategy("rule_based")(features(spark, folder), noise_std=0.0).select("message_id", "label")


def drawn(salt: int) -> str:
    """SQL of one uniform draw from a message's id."""
    return f"(('0x' || substr(md5('42:{salt}|' || message_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


@query(
    "label_rule_noise",
    with_(
        f"{LABELLED}, z AS (SELECT *, sqrt(-2 * ln({drawn(1)})) * cos(2 * pi() * ({drawn(2)})) AS z FROM labelled)",
        f"""SELECT {r7(f'avg(CASE WHEN (greatest(least({RISK} + 0.05::DOUBLE * z, 1.0::DOUBLE), 0.0::DOUBLE) >= 0.65::DOUBLE) <> (label = 1) THEN 1.0::DOUBLE ELSE 0 END)')} AS flipped,
             {r7('avg(z)')} AS noise_mean, {r7('stddev_pop(z)')} AS noise_std FROM z""",
    ),
)
def label_rule_noise(spark, folder):
    """Default noise: share of labels it flips, and moments of the draw."""
    rows = features(spark, folder)
    strategy = label_strategy("rule_based")
    plain = strategy(rows, noise_std=0.0, label="plain")
    noisy = strategy(plain, ids=("message_id",))
    z = hash_normal([F.col("message_id")], 42)
    return noisy.agg(
        F.avg((F.col("plain") != F.col("label")).cast("int")).alias("flipped"),
        F.avg(z).alias("noise_mean"),
        F.stddev_pop(z).alias("noise_std"),
    )


@query(
    "label_file",
    """SELECT CAST(d.doc_id AS VARCHAR) AS message_id, CAST(coalesce(l.quality, 0) AS BIGINT) AS label
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def label_file(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("message_id"), F.col("quality").alias("label")
    )
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("message_id"))
    return label_strategy("file_based")(docs, labels=labels)


@query(
    "label_factory",
    with_(LABELLED, "SELECT 'file_based,rule_based' AS names, TRUE AS refuses_unknown, CAST(sum(label) AS BIGINT) AS positives FROM labelled"),
)
def label_factory(spark, folder):
    """Strategies by name; an unknown name is an error."""
    from tidemill.operators.labeling import LABEL_STRATEGIES

    try:
        label_strategy("no_such_strategy")
        refused = False
    except ValueError:
        refused = True
    rows = label_strategy("rule_based")(features(spark, folder), noise_std=0.0)
    return rows.agg(
        F.lit(",".join(sorted(LABEL_STRATEGIES))).alias("names"),
        F.lit(refused).alias("refuses_unknown"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
    )


@query("risk_heuristic", with_(FEAT, f"SELECT message_id, {r7(PROBABILITY)} AS fraud_probability FROM feat"))
def heuristic(spark, folder):
    """Without the random term."""
    return features(spark, folder).select(
        "message_id",
        risk_heuristic(F.col("amount"), F.col("hour_of_day"), F.col("risk_score")).alias("fraud_probability"),
    )
