"""Structured Streaming operators, run to the end of the supplied table.

Each query drives a stream over the ``events`` table into files below the
shared folder and returns what was written. A window is written once the
watermark has passed its end, so the last windows of the table are not there.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemill.catalog.aggregates import USER_AGGREGATES
from tidemill.catalog.monitoring import STATE_SQL, alert_series
from tidemill.catalog.records import DOCS
from tidemill.catalog.registry import EV, FEAT, NOW, bucket, query, r7, with_
from tidemill.config import ValidationRules, WindowSpec
from tidemill.operators.alerts import ALERT_RULES
from tidemill.operators.extract import extract_features, features_of
from tidemill.plans.features import FeatureSettings
from tidemill.operators.store import FeatureTable
from tidemill.session import table, work_path
from tidemill.sources import adapters
from tidemill.streaming.alerts import alert_state_stream
from tidemill.streaming.job import (
    ErrorLimits,
    TooManyErrors,
    finish,
    read_table_stream,
    start_feature_job,
    start_file_query,
)
from tidemill.streaming.windows import aggregate_stream, drop_redelivered, output_mode

CLOSED = "(SELECT max(ts) - INTERVAL 5 MINUTE FROM events)"


def stream_features(spark, folder):
    rows = adapters.transactions(read_table_stream(spark, folder, "events"))
    return features_of(extract_features(rows, processing_time=NOW))


def run_aggregate(spark, folder, spec):
    """Aggregate the stream to files and read them."""
    root = work_path(spark, "stream")
    rows = aggregate_stream(stream_features(spark, folder), spec)
    finish([start_file_query(rows, f"{root}/out", f"{root}/checkpoint", mode=output_mode(spec))])
    return spark.read.schema(rows.schema).parquet(f"{root}/out").select(*rows.columns)


@query(
    "st_tumbling",
    with_(
        FEAT,
        f"""SELECT * FROM (SELECT user_id, {bucket(3600)} AS window_from, {bucket(3600)} + INTERVAL 1 HOUR AS window_to, {USER_AGGREGATES}
           FROM feat GROUP BY ALL) WHERE window_to <= {CLOSED}""",
    ),
    digits=9,
)
def st_tumbling(spark, folder):
    """Fixed windows of an hour."""
    return run_aggregate(spark, folder, WindowSpec("fixed", "1 hour"))


@query(
    "st_sliding",
    with_(
        f"{FEAT}, slid AS (SELECT feat.*, {bucket(1800)} - s * INTERVAL 30 MINUTE AS w FROM feat, (VALUES (0), (1)) v(s))",
        f"""SELECT user_id, w AS window_from, w + INTERVAL 1 HOUR AS window_to, {USER_AGGREGATES}
           FROM slid GROUP BY ALL HAVING w + INTERVAL 1 HOUR <= {CLOSED}""",
    ),
    digits=9,
)
def st_sliding(spark, folder):
    """Windows of an hour every half hour."""
    return run_aggregate(spark, folder, WindowSpec("sliding", "1 hour", "30 minutes"))


@query(
    "st_tumbling_sketch",
    with_(
        FEAT,
        f"""SELECT user_id, window_from, window_to, record_count, {r7('total')} AS total_amount, TRUE AS median_fits, TRUE AS merchants_fit FROM (
             SELECT user_id, {bucket(86400)} AS window_from, {bucket(86400)} + INTERVAL 1 DAY AS window_to, count(*) AS record_count, sum(coalesce(amount, 0)) AS total
             FROM feat GROUP BY ALL) WHERE window_to <= {CLOSED}""",
    ),
    digits=9,
)
def st_tumbling_sketch(spark, folder):
    """Windows of a day in state of fixed size; medians and counts are held against the exact ones."""
    root = work_path(spark, "stream")
    rows = aggregate_stream(stream_features(spark, folder), WindowSpec("fixed", "1 day"), summaries="sketch")
    finish([start_file_query(rows, f"{root}/out", f"{root}/checkpoint")])
    found = spark.read.schema(rows.schema).parquet(f"{root}/out").alias("f")
    batch = features_of(extract_features(adapters.transactions(table(spark, folder, "events")), processing_time=NOW))
    values = batch.select("user_id", F.window("event_time", "1 day").alias("window"), "amount", "merchant_category").alias("v")
    amount = F.coalesce("v.amount", F.lit(0.0))
    checked = found.join(values, (F.col("f.user_id") == F.col("v.user_id")) & (F.col("f.window") == F.col("v.window"))).groupBy(
        "f.user_id", "f.window", "record_count", "total_amount", "median_amount", "unique_merchants"
    ).agg(
        F.avg((amount < F.col("median_amount")).cast("int")).alias("below"),
        F.avg((amount <= F.col("median_amount")).cast("int")).alias("upto"),
        F.count_distinct(F.coalesce("v.merchant_category", F.lit(""))).alias("merchants"),
    )
    return checked.select(
        "user_id",
        "window",
        "record_count",
        "total_amount",
        ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("median_fits"),
        (F.abs(F.col("unique_merchants") - F.col("merchants")) <= F.ceil(F.col("merchants") * 0.08)).alias("merchants_fit"),
    )


SESSIONS = f"""{FEAT}, marked AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM feat),
  sess AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked),
  bounds AS (SELECT *, min(ts) OVER (PARTITION BY user_id, session) AS lo, max(ts) OVER (PARTITION BY user_id, session) + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND AS hi FROM sess)"""


@query(
    "st_session",
    with_(
        SESSIONS,
        f"""SELECT user_id, lo AS window_from, hi AS window_to, {USER_AGGREGATES} FROM bounds GROUP BY user_id, lo, hi HAVING hi <= {CLOSED}""",
    ),
    digits=9,
)
def st_session(spark, folder):
    """Sessions that end after six idle hours."""
    return run_aggregate(spark, folder, WindowSpec("session", gap="6 hours"))


@query(
    "session_batch",
    with_(SESSIONS, f"SELECT user_id, lo AS window_from, hi AS window_to, {USER_AGGREGATES} FROM bounds GROUP BY user_id, lo, hi"),
    digits=9,
)
def session_batch(spark, folder):
    """The same sessions in batch, where all of them are closed."""
    from tidemill.operators.aggregate import aggregate_users

    rows = features_of(extract_features(adapters.transactions(table(spark, folder, "events")), processing_time=NOW))
    return aggregate_users(rows, WindowSpec("session", gap="6 hours"))


@query("st_none", with_(FEAT, f"SELECT user_id, {USER_AGGREGATES} FROM feat GROUP BY user_id"),
    digits=9,
)
def st_none(spark, folder):
    """No windowing: one group per user; a trigger writes the users it changes."""
    return run_aggregate(spark, folder, WindowSpec("none"))


@query(
    "st_lateness",
    with_(
        FEAT,
        f"""SELECT * FROM (SELECT {bucket(3600)} AS window_from, {bucket(3600)} + INTERVAL 1 HOUR AS window_to, count(*) AS "rows" FROM feat
           GROUP BY ALL) WHERE window_to <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)""",
    ),
)
def st_lateness(spark, folder):
    """A lateness of three days keeps the windows of the last three days open."""
    root = work_path(spark, "stream")
    rows = (
        stream_features(spark, folder)
        .withWatermark("event_time", "3 days")
        .groupBy(F.window("event_time", "1 hour"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    finish([start_file_query(rows, f"{root}/out", f"{root}/checkpoint")])
    return spark.read.schema(rows.schema).parquet(f"{root}/out").select(*rows.columns)


@query("stream_dedup", with_(FEAT, "SELECT DISTINCT message_id FROM feat"))
def stream_dedup(spark, folder):
    """Every message is delivered three times."""
    root = work_path(spark, "stream")
    rows = stream_features(spark, folder).select("message_id", "event_time")
    copies = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    single = drop_redelivered(copies.drop("copy")).select("message_id")
    finish([start_file_query(single, f"{root}/out", f"{root}/checkpoint")])
    return spark.read.schema(single.schema).parquet(f"{root}/out")


JOB_SETTINGS = FeatureSettings(
    rules=ValidationRules(required=("amount",), ranges={"amount": (0, 4000)}),
    window=WindowSpec("fixed", "1 day"),
    processing_time=NOW,
)
GOOD = "error IS NULL AND amount IS NOT NULL AND amount BETWEEN 0 AND 4000"


@query(
    "stream_job",
    with_(
        f"{DOCS}, timed AS (SELECT *, wall - to_minutes(CASE WHEN bad_time THEN 0 ELSE offset_minutes END) AS at_utc FROM docs)",
        f"""SELECT 'errors' AS output, count(*) FILTER (WHERE error IS NOT NULL) AS "rows" FROM docs
           UNION ALL SELECT 'features', count(*) FILTER (WHERE {GOOD}) FROM docs
           UNION ALL SELECT 'invalid_features', count(*) FILTER (WHERE error IS NULL AND NOT ({GOOD})) FROM docs
           UNION ALL SELECT 'aggregated_features', count(*) FROM (SELECT DISTINCT coalesce(user_id, 'unknown'), {bucket(86400, 'at_utc')} AS w FROM timed WHERE {GOOD})
             WHERE w + INTERVAL 1 DAY <= TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE""",
    ),
)
def stream_job(spark, folder):
    """JSON documents to features, errors, invalid rows and daily aggregates.

    Unreadable times count as the processing time, which is after all events
    and therefore moves the watermark past them.
    """
    root = work_path(spark, "job")
    source = adapters.raw_documents(read_table_stream(spark, folder, "events"))
    finish(start_feature_job(source, f"{root}/out", f"{root}/checkpoint", JOB_SETTINGS, "value"))
    counts = []
    for name in ("features", "errors", "invalid_features", "aggregated_features"):
        rows = spark.read.parquet(f"{root}/out/{name}")
        counts.append(rows.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("rows")))
    result = counts[0]
    for frame in counts[1:]:
        result = result.unionByName(frame)
    return result


@query(
    "stream_store",
    with_(
        DOCS,
        f"""SELECT user_id AS entity_id, TRUE AS is_active FROM docs WHERE {GOOD} AND user_id <> 'unknown' GROUP BY user_id""",
    ),
)
def stream_store(spark, folder):
    """The job with the feature store as its output: one row per known user."""
    root = work_path(spark, "store-job")
    source = adapters.raw_documents(read_table_stream(spark, folder, "events"))
    settings = replace(JOB_SETTINGS, window=None)
    finish(start_feature_job(source, f"{root}/out", f"{root}/checkpoint", settings, "value", output="store"))
    return FeatureTable(spark, f"{root}/out/store").read().select("entity_id", "is_active")


@query("stateful_alert", STATE_SQL)
def stateful_alert(spark, folder):
    """Alert states on a stream; a test compares them with the batch form."""
    root = work_path(spark, "alerts")
    pairs = [p for r in ALERT_RULES for p in (F.lit(r.name), F.coalesce(F.expr(r.condition), F.lit(False)))]
    evaluations = alert_series(spark, folder).select(
        F.col("step").alias("ts"), F.explode(F.create_map(*pairs)).alias("alert", "met")
    )
    evaluations.write.parquet(f"{root}/evaluations")
    # Files come one by one in any order; a closing mark lets the watermark pass all of them.
    span = spark.read.parquet(f"{root}/evaluations").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lateness = f"{span.select(F.expr('coalesce(timestampdiff(MINUTE, lo, hi), 0) + 1')).first()[0]} minutes"
    mark = span.select((F.col("hi") + F.expr(f"INTERVAL {lateness}") * 2).alias("ts"), F.lit(None).cast("string").alias("alert"), F.lit(False).alias("met"))
    mark.write.mode("append").parquet(f"{root}/evaluations")
    source = spark.readStream.schema(evaluations.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/evaluations")
    states = alert_state_stream(source, cooldown_minutes=60, lateness=lateness)
    finish([start_file_query(states, f"{root}/out", f"{root}/checkpoint")])
    return spark.read.schema(states.schema).parquet(f"{root}/out")


@query(
    "dead_letter_limits",
    with_(EV, "SELECT count(*) AS documents, TRUE AS stopped FROM ev"),
)
def dead_letter_limits(spark, folder):
    """A quarter of the documents cannot be read: the job must stop."""
    root = work_path(spark, "limits")
    source = adapters.raw_documents(read_table_stream(spark, folder, "events"))
    settings = FeatureSettings(window=None, processing_time=NOW)
    try:
        finish(start_feature_job(source, f"{root}/out", f"{root}/checkpoint", settings, "value", ErrorLimits()))
        stopped = False
    except Exception as error:
        stopped = TooManyErrors.__name__ in str(error)
    return table(spark, folder, "events").agg(
        F.count(F.lit(1)).alias("documents"), F.lit(stopped).alias("stopped")
    )
