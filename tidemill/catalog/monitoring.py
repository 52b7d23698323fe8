"""Monitoring over the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.registry import (
    CHANNEL_CASE,
    EV,
    FEAT,
    LOG,
    bucket,
    features,
    log,
    query,
    r7,
    with_,
)
from tidemill.operators import alerts as A
from tidemill.operators import drift as D
from tidemill.operators import monitor as M
from tidemill.session import table
from tidemill.sources import adapters

TS = "request_timestamp"


def edges(seconds: int, column: str = TS) -> str:
    b = bucket(seconds, column)
    return f"{b} AS window_from, {b} + INTERVAL '{seconds} seconds' AS window_to"


def share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def qc(q: float, column: str = "latency_ms / 1000") -> str:
    return f"quantile_cont({column}, {q})"


@query(
    "success_rate_5m",
    with_(LOG, f"""SELECT {edges(300)}, model_name, count(*) AS requests, {r7(share("status = 'success'"))} AS success_rate FROM plog GROUP BY ALL"""),
)
def success_rate_5m(spark, folder):
    return M.success_rate(log(spark, folder))


@query(
    "error_rate",
    with_(
        LOG,
        f"""SELECT {edges(300)}, model_name, {r7(share("status = 'error'"))} AS error_rate,
             {r7(share('status_code BETWEEN 400 AND 599'))} AS http_error_rate FROM plog GROUP BY ALL""",
    ),
)
def error_rate(spark, folder):
    return M.error_rate(log(spark, folder))


def loads(spark, folder):
    """Loader requests of the log as model loads."""
    return log(spark, folder).filter("component = 'loader'").withColumn("load_seconds", F.col("latency_ms") / 100)


@query(
    "load_success_rate",
    with_(LOG, f"""SELECT {edges(3600)}, {r7(share("status = 'success'"))} AS load_success_rate FROM plog WHERE component = 'loader' GROUP BY ALL"""),
)
def load_success_rate(spark, folder):
    return M.load_success_rate(loads(spark, folder), "1 hour")


@query(
    "latency_quantiles",
    with_(
        LOG,
        f"""SELECT {edges(300)}, model_name, count(*) AS requests, {r7(qc(0.5))} AS p50, {r7(qc(0.95))} AS p95, {r7(qc(0.99))} AS p99
           FROM plog WHERE latency_ms IS NOT NULL GROUP BY ALL""",
    ),
)
def latency_quantiles(spark, folder):
    return M.latency_quantiles(log(spark, folder))


@query(
    "latency_quantiles_by_version",
    with_(
        LOG,
        f"""SELECT model_name, model_version, count(*) AS requests, {r7(qc(0.5))} AS p50, {r7(qc(0.95))} AS p95, {r7(qc(0.99))} AS p99
           FROM plog WHERE latency_ms IS NOT NULL GROUP BY ALL""",
    ),
)
def latency_quantiles_by_version(spark, folder):
    return M.latency_quantiles(log(spark, folder), None, ("model_name", "model_version"))


def _bucket_sql(q: float) -> str:
    tests = []
    for i, edge in enumerate(M.REQUEST_EDGES):
        lower = M.REQUEST_EDGES[i - 1] if i else 0.0
        before = f"le{i - 1}" if i else "0"
        tests.append(
            f"WHEN le{i} >= {q}::DOUBLE * requests THEN {lower}::DOUBLE + ({edge}::DOUBLE - {lower}::DOUBLE) "
            f"* coalesce(({q}::DOUBLE * requests - {before}) / nullif(le{i} - {before}, 0), 0)"
        )
    return f"CASE {' '.join(tests)} ELSE {M.REQUEST_EDGES[-1]}::DOUBLE END"


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE latency_ms / 1000 <= {e}::DOUBLE) AS le{i}" for i, e in enumerate(M.REQUEST_EDGES)
)


@query(
    "latency_histogram_quantiles",
    with_(
        f"{LOG}, counted AS (SELECT {edges(3600)}, model_name, count(*) AS requests, {_COUNTS} FROM plog WHERE latency_ms IS NOT NULL GROUP BY ALL)",
        f"""SELECT window_from, window_to, model_name, requests, {r7(_bucket_sql(0.5))} AS p50, {r7(_bucket_sql(0.95))} AS p95,
             {r7(_bucket_sql(0.99))} AS p99 FROM counted""",
    ),
)
def latency_histogram_quantiles(spark, folder):
    """Interpolated inside buckets, as a metrics server does it."""
    return M.histogram_quantiles(log(spark, folder), "1 hour")


@query(
    "avg_latency",
    with_(LOG, f"SELECT {edges(300)}, model_name, {r7('avg(latency_ms) / 1000')} AS avg_latency_seconds FROM plog GROUP BY ALL"),
)
def avg_latency(spark, folder):
    return M.average_latency(log(spark, folder))


@query(
    "throughput",
    with_(
        LOG,
        f"""SELECT {edges(300)}, model_name, model_version, count(*) AS requests, {r7('count(*) / 300.0::DOUBLE')} AS per_second,
             {r7('count(*) * 60 / 300.0::DOUBLE')} AS per_minute FROM plog GROUP BY ALL""",
    ),
)
def throughput(spark, folder):
    return M.throughput(log(spark, folder))


@query(
    "increase",
    with_(
        LOG,
        """SELECT model_name, count(*) FILTER (WHERE request_timestamp > TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR AND request_timestamp <= TIMESTAMP '2024-01-20') AS last_hour,
             count(*) FILTER (WHERE request_timestamp > TIMESTAMP '2024-01-19' AND request_timestamp <= TIMESTAMP '2024-01-20') AS last_day,
             count(*) AS total FROM plog GROUP BY model_name""",
    ),
)
def increase(spark, folder):
    return M.increase(log(spark, folder), F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query(
    "cache_hit_rate",
    with_(
        LOG,
        f"""SELECT count(*) FILTER (WHERE status = 'cache_hit') AS hits, count(*) AS requests, {r7(share("status = 'cache_hit'"))} AS cache_hit_rate FROM plog""",
    ),
)
def cache_hit_rate(spark, folder):
    return M.cache_hit_rate(log(spark, folder))


@query(
    "cache_hit_rate_by_group",
    with_(
        LOG,
        f"""SELECT component, count(*) FILTER (WHERE status = 'cache_hit') AS hits, count(*) AS requests,
             {r7(share("status = 'cache_hit'"))} AS cache_hit_rate FROM plog GROUP BY component""",
    ),
)
def cache_hit_rate_by_group(spark, folder):
    return M.cache_hit_rate(log(spark, folder), ("component",))


@query(
    "apdex",
    with_(
        LOG,
        f"""SELECT {edges(3600)}, model_name, {r7('(count(*) FILTER (WHERE latency_ms / 1000 <= 0.1::DOUBLE) + count(*) FILTER (WHERE latency_ms / 1000 > 0.1::DOUBLE AND latency_ms / 1000 <= 0.5::DOUBLE) / 2.0::DOUBLE) / count(*)')} AS apdex
           FROM plog WHERE latency_ms IS NOT NULL GROUP BY ALL""",
    ),
)
def apdex(spark, folder):
    return M.apdex(log(spark, folder), "1 hour")


@query(
    "slo",
    with_(
        f"""{LOG}, rates AS (SELECT {edges(3600)}, model_name, count(*) AS requests, {share("status = 'success'")} AS s FROM plog GROUP BY ALL),
          q AS (SELECT {edges(3600)}, model_name, {qc(0.5)} AS p50, {qc(0.95)} AS p95, {qc(0.99)} AS p99 FROM plog WHERE latency_ms IS NOT NULL GROUP BY ALL)""",
        f"""SELECT r.window_from, r.window_to, r.model_name, requests, {r7('s')} AS success_rate, {r7('p50')} AS p50, {r7('p95')} AS p95, {r7('p99')} AS p99,
             p95 < 0.1 AS p95_met, p99 < 0.5 AS p99_met, s > 0.999 AS availability_met, {r7('1 - s')} AS budget_burn,
             CASE WHEN s > 0.99 THEN 'good' WHEN s >= 0.95 THEN 'warning' ELSE 'critical' END AS success_band,
             CASE WHEN p95 < 0.1 THEN 'good' WHEN p95 <= 0.5 THEN 'warning' ELSE 'critical' END AS p95_band,
             CASE WHEN p99 < 0.5 THEN 'good' WHEN p99 <= 1.0 THEN 'warning' ELSE 'critical' END AS p99_band
           FROM rates r LEFT JOIN q ON q.window_from = r.window_from AND q.model_name = r.model_name""",
    ),
)
def slo(spark, folder):
    return M.objectives(log(spark, folder))


@query(
    "peak_rate",
    with_(
        LOG,
        f"""SELECT CAST(CAST(b AS DATE) AS VARCHAR) AS day, {r7('max(n) / 300.0::DOUBLE')} AS peak_per_second
           FROM (SELECT {bucket(300, TS)} AS b, count(*) AS n FROM plog GROUP BY 1) GROUP BY 1""",
    ),
)
def peak_rate(spark, folder):
    return M.peak_rate(log(spark, folder))


@query(
    "avg_over_time",
    with_(
        EV,
        f"""SELECT {edges(3600, 'ts')}, 'app_' || event_type AS name, {r7('avg(value)')} AS avg_value, {r7('avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) * 100')} AS uptime_percent
           FROM ev GROUP BY ALL""",
    ),
)
def avg_over_time(spark, folder):
    samples = adapters.metric_samples(table(spark, folder, "events"))
    return M.average_over_time(samples, "1 hour", F.col("value") > 50)


def alert_series(spark, folder):
    """Error rate, latency, hit rate, volume and success per five-minute step, gaps filled."""
    rows = log(spark, folder)
    window = F.col("window.start").alias("step")
    timed = rows.groupBy(F.window(TS, "5 minutes").alias("window")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((F.col("status") == "error").cast("int")).alias("error_rate"),
        F.avg((F.col("status") == "cache_hit").cast("int")).alias("cache_hit_rate"),
        F.max((F.col("status") != "error").cast("int")).alias("up"),
    )
    slow = M.latency_quantiles(rows, "5 minutes", ()).select(window, "p95")
    known = timed.select(window, "requests", "error_rate", "cache_hit_rate", "up").join(slow, "step", "left")
    return A.fill_steps(known, "5 minutes").withColumn("requests", F.coalesce("requests", F.lit(0)))


ALERT_SERIES = f"""{LOG}, steps AS (SELECT {bucket(300, TS)} AS step, count(*) AS requests, {share("status = 'error'")} AS error_rate,
    {share("status = 'cache_hit'")} AS cache_hit_rate, max(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) AS up,
    quantile_cont(latency_ms / 1000, 0.95) AS p95 FROM plog GROUP BY 1),
  spine AS (SELECT unnest(generate_series((SELECT min(step) FROM steps), (SELECT max(step) FROM steps), INTERVAL 5 MINUTE)) AS step),
  series AS (SELECT spine.step, coalesce(requests, 0) AS requests, error_rate, cache_hit_rate, up, p95 FROM spine LEFT JOIN steps ON steps.step = spine.step)"""
RULES_SQL = " UNION ALL ".join(
    f"SELECT step, '{r.name}' AS alert, '{r.severity}' AS severity, {r.hold_minutes} AS hold, coalesce({r.condition}, FALSE) AS met FROM series"
    for r in A.ALERT_RULES
)


@query(
    "alerts_for",
    with_(
        f"""{ALERT_SERIES}, evals AS ({RULES_SQL}),
          marked AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY step) - row_number() OVER (PARTITION BY alert, met ORDER BY step) AS island FROM evals)""",
        """SELECT alert, severity, min(step) AS started_at, max(step) AS last_at, count(*) AS steps,
             max(step) >= min(step) + to_minutes(CAST(max(hold) AS INTEGER)) AS firing,
             CASE WHEN max(step) >= min(step) + to_minutes(CAST(max(hold) AS INTEGER)) THEN min(step) + to_minutes(CAST(max(hold) AS INTEGER)) END AS fired_at
           FROM marked WHERE met GROUP BY alert, severity, island""",
    ),
)
def alerts_for(spark, folder):
    return A.held_alerts(alert_series(spark, folder))


STATE_SQL = with_(
    f"""RECURSIVE {ALERT_SERIES}, evals AS ({RULES_SQL}),
      marked AS (SELECT *, met AND NOT coalesce(lag(met) OVER w, FALSE) AS begins FROM evals WINDOW w AS (PARTITION BY alert ORDER BY step)),
      episodes AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY alert ORDER BY step) AS episode FROM marked),
      notices AS (
        SELECT alert, min(step) AS sent FROM evals WHERE met GROUP BY alert
        UNION ALL
        SELECT n.alert, (SELECT min(e.step) FROM evals e WHERE e.alert = n.alert AND e.met AND e.step >= n.sent + INTERVAL 60 MINUTE)
        FROM notices n WHERE n.sent IS NOT NULL),
      told AS (SELECT alert, sent FROM notices WHERE sent IS NOT NULL)""",
    """SELECT e.alert, e.step AS ts, e.met, CASE WHEN e.met THEN 'active' ELSE 'resolved' END AS status,
         CAST(CASE WHEN episode = 0 THEN 0 ELSE sum(CASE WHEN e.met THEN 1 ELSE 0 END) OVER w END AS BIGINT) AS trigger_count,
         t.sent IS NOT NULL AS notified,
         CASE WHEN episode > 0 THEN min(e.step) OVER (PARTITION BY e.alert, episode) END AS first_triggered,
         max(t.sent) OVER (PARTITION BY e.alert ORDER BY e.step) AS last_notified,
         CASE WHEN episode > 0 AND NOT e.met THEN min(CASE WHEN NOT e.met THEN e.step END) OVER (PARTITION BY e.alert, episode) END AS resolved_at
       FROM episodes e LEFT JOIN told t ON t.alert = e.alert AND t.sent = e.step
       WINDOW w AS (PARTITION BY e.alert, episode ORDER BY e.step)""",
)


@query("alert_state", STATE_SQL)
def alert_state(spark, folder):
    """Status, trigger count and notices after each evaluation."""
    rules = {r.name: r.condition for r in A.ALERT_RULES}
    pairs = [p for n, c in rules.items() for p in (F.lit(n), F.coalesce(F.expr(c), F.lit(False)))]
    evaluations = alert_series(spark, folder).select("step", F.explode(F.create_map(*pairs)).alias("alert", "met"))
    return A.alert_states(evaluations.withColumnRenamed("step", "ts"), cooldown_minutes=60)


@query(
    "alert_status_runs",
    with_(
        f"{ALERT_SERIES}, evals AS ({RULES_SQL}), prev AS (SELECT *, lag(met) OVER (PARTITION BY alert ORDER BY step) AS before FROM evals)",
        """SELECT alert, count(*) AS evaluations, count(*) FILTER (WHERE met) AS triggered, count(*) FILTER (WHERE met AND NOT coalesce(before, FALSE)) AS activations,
             count(*) FILTER (WHERE met) AS active_rows FROM prev GROUP BY alert""",
    ),
)
def alert_status_runs(spark, folder):
    """The parts of the state machine that have a closed form."""
    states = alert_state(spark, folder)
    return states.groupBy("alert").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_if("met").alias("triggered"),
        F.count_if(F.col("met") & (F.col("trigger_count") == 1)).alias("activations"),
        F.count_if(F.col("status") == "active").alias("active_rows"),
    )


@query(
    "alert_rules_yaml",
    with_(
        LOG,
        f"""SELECT alert, name, ts, {r7('value')} AS value, threshold FROM (
             SELECT 'stream_error_rate_high' AS alert, 'stream_error_rate' AS name, {bucket(3600, TS)} AS ts, {share("status = 'error'")} AS value, 0.01::DOUBLE AS threshold FROM plog GROUP BY 3
             UNION ALL SELECT 'cache_miss_rate_high', 'cache_miss_rate', {bucket(3600, TS)}, 1 - {share("status = 'cache_hit'")}, 0.3::DOUBLE FROM plog GROUP BY 3
             UNION ALL SELECT 'model_accuracy_drop', 'accuracy', {bucket(3600, TS)}, {share('predicted = actual')}, 0.85::DOUBLE FROM plog GROUP BY 3)
           WHERE CASE WHEN alert = 'model_accuracy_drop' THEN value < threshold ELSE value > threshold END""",
    ),
)
def alert_rules_yaml(spark, folder):
    hourly = log(spark, folder).groupBy(F.window(TS, "1 hour")["start"].alias("ts")).agg(
        F.avg((F.col("status") == "error").cast("int")).alias("stream_error_rate"),
        (1 - F.avg((F.col("status") == "cache_hit").cast("int"))).alias("cache_miss_rate"),
        F.avg((F.col("predicted") == F.col("actual")).cast("int")).alias("accuracy"),
    )
    names = ("stream_error_rate", "cache_miss_rate", "accuracy")
    metrics = hourly.select(
        "ts", F.explode(F.create_map(*[p for n in names for p in (F.lit(n), F.col(n))])).alias("name", "value")
    )
    thresholds = spark.createDataFrame(
        list(A.METRIC_THRESHOLDS), "alert string, metric string, comparison string, threshold double"
    )
    return A.metric_alerts(metrics, thresholds)


def _index(q: float) -> str:
    return f"list_sort(list(v))[CAST(floor(count(v) * {q}::DOUBLE) AS BIGINT) + 1]"


@query(
    "histogram_stats",
    f"""SELECT event_type, count(v) AS count, {r7('sum(v)')} AS sum, {r7('min(v)')} AS min, {r7('max(v)')} AS max, {r7('avg(v)')} AS mean,
         {r7(_index(0.5))} AS p50, {r7(_index(0.9))} AS p90, {r7(_index(0.95))} AS p95, {r7(_index(0.99))} AS p99
       FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type""",
)
def histogram_stats(spark, folder):
    """Quantiles by index into the sorted values."""
    return M.histogram_stats(table(spark, folder, "events"), ["event_type"], "value")


@query(
    "counters_gauges",
    with_(
        EV,
        f"""SELECT kind, key, {r7("CASE WHEN kind = 'counter' THEN sum(value) ELSE arg_max(value, (ts, event_id)) END")} AS value FROM (
             SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'counter' ELSE 'gauge' END AS kind,
               'app_' || event_type || '{{channel=' || {CHANNEL_CASE} || ',shard=' || (user_id % 4) || '}}' AS key FROM ev) GROUP BY kind, key""",
    ),
)
def counters_gauges(spark, folder):
    return M.counters_and_gauges(adapters.metric_samples(table(spark, folder, "events")))


@query(
    "load_report",
    with_(
        LOG,
        f"""SELECT count(*) AS requests, {r7('min(latency_ms)')} AS min_ms, {r7('avg(latency_ms)')} AS avg_ms, {r7('max(latency_ms)')} AS max_ms,
             {r7(share("status <> 'error'") + ' * 100')} AS success_percent, {r7(qc(0.5, 'latency_ms'))} AS p50, {r7(qc(0.95, 'latency_ms'))} AS p95, {r7(qc(0.99, 'latency_ms'))} AS p99
           FROM plog""",
    ),
)
def load_report(spark, folder):
    return M.load_report(log(spark, folder))


@query(
    "health_rollup",
    with_(
        EV,
        f"""SELECT {edges(3600, 'ts')}, CASE WHEN bool_or(k < 2) THEN 'unhealthy' WHEN bool_or(k < 20) THEN 'degraded' ELSE 'healthy' END AS overall, count(*) AS checks
           FROM ev GROUP BY ALL""",
    ),
)
def health_rollup(spark, folder):
    k = F.col("k")
    checks = adapters.with_k(table(spark, folder, "events")).select(
        F.window(F.col("ts").cast("timestamp"), "1 hour").alias("window"),
        F.when(k < 2, "unhealthy").when(k < 10, "degraded").when(k < 20, "unknown").otherwise("healthy").alias("state"),
    )
    return M.health_rollup(checks, ["window"])


def _drift_sql() -> str:
    feats = ("amount", "risk_score")
    ref = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM feat WHERE ts < TIMESTAMP '2024-01-11'" for f in feats)
    cur = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {bucket(86400 * 7)} AS w, {f} AS v FROM feat WHERE ts >= TIMESTAMP '2024-01-11'" for f in feats
    )
    qs = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(1, 10))
    return f"""{FEAT}, ref AS ({ref}), cur AS ({cur}), e AS (SELECT feature, [{qs}] AS edges FROM ref GROUP BY feature),
      rb AS (SELECT ref.feature, len(list_filter(edges, lambda x: v > x)) AS b FROM ref JOIN e ON e.feature = ref.feature),
      cb AS (SELECT cur.feature, w, len(list_filter(edges, lambda x: v > x)) AS b FROM cur JOIN e ON e.feature = cur.feature),
      bins AS (SELECT unnest(range(10)) AS b),
      q AS (SELECT f.feature, bins.b, greatest(count(rb.b)::DOUBLE / any_value(f.n), 1e-4) AS q FROM (SELECT feature, count(*) AS n FROM rb GROUP BY 1) f, bins
        LEFT JOIN rb ON rb.feature = f.feature AND rb.b = bins.b GROUP BY 1, 2),
      p AS (SELECT f.feature, f.w, bins.b, any_value(f.n) AS n, greatest(count(cb.b)::DOUBLE / any_value(f.n), 1e-4) AS p FROM (SELECT feature, w, count(*) AS n FROM cb GROUP BY 1, 2) f, bins
        LEFT JOIN cb ON cb.feature = f.feature AND cb.w = f.w AND cb.b = bins.b GROUP BY 1, 2, 3),
      scores AS (SELECT p.feature, p.w, any_value(n) AS "rows", sum((p - q) * ln(p / q)) AS psi, sum(p * ln(p / q)) AS kl,
        sum((p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2) AS js FROM p JOIN q ON q.feature = p.feature AND q.b = p.b GROUP BY 1, 2)"""


def drifted(spark, folder):
    rows = features(spark, folder)
    cut = F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    current = rows.filter(F.col("event_wall") >= cut).withColumn("window", F.window("event_time", "7 days"))
    return D.drift(current, rows.filter(F.col("event_wall") < cut), ["amount", "risk_score"], ["window"])


@query(
    "drift",
    with_(
        _drift_sql(),
        f"""SELECT feature, w AS window_from, w + INTERVAL 7 DAY AS window_to, "rows", {r7('psi')} AS psi, {r7('kl')} AS kl_divergence,
             {r7('js')} AS js_divergence, psi > 0.1 AS drifted FROM scores""",
    ),
)
def drift(spark, folder):
    """Weekly windows against the first ten days."""
    return drifted(spark, folder)


@query(
    "drift_summary",
    with_(
        _drift_sql(),
        f"""SELECT w AS window_from, w + INTERVAL 7 DAY AS window_to, {r7('max(psi)')} AS drift_score,
             coalesce(string_agg(CASE WHEN psi > 0.1 THEN feature END, '|' ORDER BY feature), '') AS drifted_features, bool_or(psi > 0.1) AS drift_detected
           FROM scores GROUP BY w""",
    ),
)
def drift_summary(spark, folder):
    return D.drift_summary(drifted(spark, folder), ["window"])


@query(
    "business_outcomes",
    with_(
        LOG,
        f"""SELECT model_name, count(*) FILTER (WHERE predicted = 1 AND actual = 1) AS fraud_detected, count(*) FILTER (WHERE predicted = 1 AND actual = 0) AS false_positives,
             count(*) FILTER (WHERE predicted = 0 AND actual = 1) AS false_negatives,
             {r7('sum(CASE WHEN predicted = 1 AND actual = 1 THEN amount ELSE 0.0::DOUBLE END)')} AS money_saved FROM plog GROUP BY model_name""",
    ),
)
def business_outcomes(spark, folder):
    rows = log(spark, folder)
    joined = M.prediction_outcome(rows.drop("actual"), rows.select("request_id", "actual"))
    return M.business_outcomes(joined)


@query(
    "top_errors",
    with_(
        LOG,
        """SELECT error_type, component, count(*) AS errors FROM plog WHERE error_type IS NOT NULL GROUP BY ALL
           ORDER BY errors DESC, error_type, component LIMIT 10""",
    ),
)
def top_errors(spark, folder):
    """The ten largest counts: the limit is the feature."""
    return M.top_errors(log(spark, folder).filter("error_type IS NOT NULL"))


@query(
    "component_errors",
    with_(
        LOG,
        f"""SELECT {edges(300)}, component, count(error_type) AS errors, {r7(share('error_type IS NOT NULL'))} AS error_share,
             {r7('count(error_type) / 300.0::DOUBLE')} AS errors_per_second FROM plog GROUP BY ALL""",
    ),
)
def component_errors(spark, folder):
    return M.component_error_rate(log(spark, folder), time=TS)


@query(
    "ingestion_lag",
    with_(
        EV,
        f"""SELECT {edges(300, 'done')}, source, {r7('max(lag)')} AS max_lag_seconds, {r7('count(*) / 300.0::DOUBLE')} AS messages_per_second,
             {r7('count(*) FILTER (WHERE failed) / 300.0::DOUBLE')} AS errors_per_second, max(lag) > 60 AS lagging
           FROM (SELECT ts + to_seconds(CAST(k AS INTEGER)) AS done, CAST(k AS DOUBLE) AS lag, {CHANNEL_CASE} AS source, event_type = 'error' AS failed FROM ev) GROUP BY ALL""",
    ),
)
def ingestion_lag(spark, folder):
    """Messages are processed k seconds after their event."""
    event_time = F.col("ts").cast("timestamp")
    messages = adapters.with_k(table(spark, folder, "events")).select(
        event_time.alias("event_time"),
        (event_time + F.make_dt_interval(secs=F.col("k").cast("decimal(18,6)"))).alias("processed_at"),
        adapters.choose(F.col("k"), adapters.CHANNELS).alias("source"),
        (F.col("event_type") == "error").alias("failed"),
    )
    return M.ingestion_lag(messages)


_LE = " ".join(f"WHEN latency_ms / 1000 <= {e}::DOUBLE THEN '{e:g}'" for e in M.HISTOGRAM_EDGES)


@query(
    "latency_heatmap",
    with_(
        LOG,
        f"SELECT {edges(60)}, CASE {_LE} ELSE '+Inf' END AS le, count(*) AS requests FROM plog WHERE latency_ms IS NOT NULL GROUP BY ALL",
    ),
)
def latency_heatmap(spark, folder):
    return M.latency_heatmap(log(spark, folder))


@query(
    "feature_requests",
    with_(LOG, "SELECT component AS feature_group, status AS operation, count(*) AS requests FROM plog GROUP BY ALL"),
)
def feature_requests(spark, folder):
    rows = log(spark, folder).select(F.col("component").alias("feature_group"), F.col("status").alias("operation"))
    return M.feature_requests(rows)


@query(
    "model_load_time",
    with_(LOG, f"SELECT model_name, {r7('avg(latency_ms / 100)')} AS avg_load_seconds FROM plog WHERE component = 'loader' GROUP BY model_name"),
)
def model_load_time(spark, folder):
    return M.model_load_time(loads(spark, folder))
