"""Service metrics from the prediction log.

Counters are event rows here: a rate over five minutes is a count in a
five-minute window divided by its seconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import ranks
from tidemill.operators.joins import latest_per_key


TIME = "request_timestamp"
# Bucket edges in seconds of the request histogram and of the
# library's own histogram.
REQUEST_EDGES = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
HISTOGRAM_EDGES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _is(status: str) -> Column:
    return F.coalesce(F.col("status") == status, F.lit(False))


def _share(status: str) -> Column:
    return F.avg(_is(status).cast("int"))


def windowed(log: DataFrame, size: str | None, by: list[str], time: str = TIME) -> tuple[DataFrame, list[str]]:
    if size is None:
        return log, by
    return log.withColumn("window", F.window(time, size)), ["window", *by]


def success_rate(log: DataFrame, size: str | None = "5 minutes", by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Successful requests over all requests."""
    rows, keys = windowed(log, size, list(by))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), _share("success").alias("success_rate")
    )


def error_rate(log: DataFrame, size: str | None = "5 minutes", by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Failed requests, and responses with a 4xx or 5xx code, over all requests."""
    rows, keys = windowed(log, size, list(by))
    return rows.groupBy(*keys).agg(
        _share("error").alias("error_rate"),
        F.avg(F.col("status_code").between(400, 599).cast("int")).alias("http_error_rate"),
    )


def load_success_rate(loads: DataFrame, size: str | None = "5 minutes") -> DataFrame:
    """Share of model loads that worked."""
    rows, keys = windowed(loads, size, [])
    return rows.groupBy(*keys).agg(_share("success").alias("load_success_rate"))


def latency_quantiles(
    log: DataFrame, size: str | None = "5 minutes", by: tuple[str, ...] = ("model_name",)
) -> DataFrame:
    """Exact p50, p95 and p99 of the latency in seconds."""
    rows, keys = windowed(log, size, list(by))
    seconds = rows.filter(F.col("latency_ms").isNotNull()).select(
        *keys, (F.col("latency_ms") / 1000.0).alias("_latency")
    )
    return ranks.quantiles(seconds, keys, "_latency", QUANTILES).withColumnRenamed("n", "requests")


def bucket_counts(edges: tuple[float, ...] = REQUEST_EDGES) -> list[Column]:
    """Cumulative bucket counts of the latency, and how many requests have one."""
    seconds = F.col("latency_ms") / 1000.0
    return [F.count("latency_ms").alias("_seen"), *[F.count_if(seconds <= edge).alias(f"_le{i}") for i, edge in enumerate(edges)]]


def bucket_quantile(q: float, edges: tuple[float, ...] = REQUEST_EDGES) -> Column:
    """A quantile read off :func:`bucket_counts` with linear interpolation; null without requests.

    A rank above the last edge gives the last edge.
    """
    rank = F.col("_seen") * F.lit(q)
    chain = F.when(F.col("_seen") == 0, F.lit(None).cast("double"))
    for i, edge in enumerate(edges):
        lower = edges[i - 1] if i else 0.0
        before = F.col(f"_le{i - 1}") if i else F.lit(0)
        inside = F.col(f"_le{i}") - before
        value = F.lit(lower) + F.lit(edge - lower) * F.coalesce(
            F.try_divide(rank - before, inside), F.lit(0.0)
        )
        chain = chain.when(F.col(f"_le{i}") >= rank, value)
    return chain.otherwise(F.lit(edges[-1]))


def histogram_quantiles(
    log: DataFrame,
    size: str | None = "5 minutes",
    by: tuple[str, ...] = ("model_name",),
    edges: tuple[float, ...] = REQUEST_EDGES,
) -> DataFrame:
    """Quantiles read off cumulative bucket counts, all in one aggregate that combines before the shuffle."""
    rows, keys = windowed(log, size, list(by))
    counted = rows.filter(F.col("latency_ms").isNotNull()).groupBy(*keys).agg(*bucket_counts(edges))
    return counted.select(
        *keys, F.col("_seen").alias("requests"), *[bucket_quantile(q, edges).alias(name) for name, q in QUANTILES.items()]
    )


def average_latency(log: DataFrame, size: str | None = "5 minutes", by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    rows, keys = windowed(log, size, list(by))
    return rows.groupBy(*keys).agg((F.avg("latency_ms") / 1000.0).alias("avg_latency_seconds"))


def throughput(log: DataFrame, size: str = "5 minutes", by: tuple[str, ...] = ("model_name", "model_version")) -> DataFrame:
    """Requests per window, per minute and per second."""
    rows, keys = windowed(log, size, list(by))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests")).withColumns(
        {
            "per_second": F.col("requests") / seconds,
            "per_minute": F.col("requests") * 60.0 / seconds,
        }
    )


def increase(log: DataFrame, now: Column, by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Requests in the last hour, the last day and ever."""
    def since(hours: int) -> Column:
        return (F.col(TIME) > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col(TIME) <= now)

    return log.groupBy(*by).agg(
        F.count_if(since(1)).alias("last_hour"),
        F.count_if(since(24)).alias("last_day"),
        F.count(F.lit(1)).alias("total"),
    )


def cache_hit_rate(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cache hits over all requests since the start.

    The published rule carries five minutes in its name but has no window.
    """
    return log.groupBy(*by).agg(
        F.count_if(_is("cache_hit")).alias("hits"),
        F.count(F.lit(1)).alias("requests"),
        _share("cache_hit").alias("cache_hit_rate"),
    )


def apdex(
    log: DataFrame,
    size: str | None = "5 minutes",
    by: tuple[str, ...] = ("model_name",),
    target: float = 0.1,
    tolerable: float = 0.5,
) -> DataFrame:
    """Satisfied requests plus half of the tolerable ones, over all timed requests."""
    rows, keys = windowed(log.filter(F.col("latency_ms").isNotNull()), size, list(by))
    seconds = F.col("latency_ms") / 1000.0
    return rows.groupBy(*keys).agg(
        (
            (F.count_if(seconds <= target) + F.count_if((seconds > target) & (seconds <= tolerable)) / 2.0)
            / F.count(F.lit(1))
        ).alias("apdex")
    )


# Objectives and the lower edges of the good and warning bands.
P95_LIMIT, P99_LIMIT, AVAILABILITY = 0.1, 0.5, 0.999


def band(value: Column, good: float, warning: float, higher_is_better: bool) -> Column:
    """``good``, ``warning`` or ``critical``."""
    if higher_is_better:
        return F.when(value > good, "good").when(value >= warning, "warning").otherwise("critical")
    return F.when(value < good, "good").when(value <= warning, "warning").otherwise("critical")


def objectives(log: DataFrame, size: str = "1 hour", by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Latency and availability objectives, bands and error-budget burn per window."""
    keys = ["window", *by]
    rates = success_rate(log, size, by)
    quantile = latency_quantiles(log, size, by).drop("requests")
    joined = rates.join(quantile, keys, "left")
    return joined.withColumns(
        {
            "p95_met": F.col("p95") < P95_LIMIT,
            "p99_met": F.col("p99") < P99_LIMIT,
            "availability_met": F.col("success_rate") > AVAILABILITY,
            "budget_burn": 1 - F.col("success_rate"),
            "success_band": band(F.col("success_rate"), 0.99, 0.95, True),
            "p95_band": band(F.col("p95"), 0.1, 0.5, False),
            "p99_band": band(F.col("p99"), 0.5, 1.0, False),
        }
    )


def peak_rate(log: DataFrame) -> DataFrame:
    """Highest five-minute request rate of each day."""
    rates = throughput(log, "5 minutes", ())
    return rates.groupBy(F.to_date("window.start").alias("day")).agg(F.max("per_second").alias("peak_per_second"))


def average_over_time(gauges: DataFrame, size: str = "1 hour", up: Column | None = None) -> DataFrame:
    """Mean of a gauge per window and the share of samples that were up."""
    up = F.col("value") > 0 if up is None else up
    return (
        gauges.groupBy(F.window("ts", size), "name")
        .agg(F.avg("value").alias("avg_value"), (F.avg(up.cast("int")) * 100).alias("uptime_percent"))
    )


def histogram_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, sum, extremes, mean and index quantiles of a metric.

    A quantile is the value at index ``int(n * q)`` of the sorted values, not
    an interpolation.
    """
    # The reported quantiles.
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    n = F.col("n")
    known = df.filter(F.col(value).isNotNull())
    basic = [
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
    ]
    crowded = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ranks.CALM_ROWS)
    if crowded.isEmpty():
        sorted_ = F.sort_array(F.collect_list(value)).alias("_sorted")
        picks = [
            F.get("_sorted", F.floor(F.col("count") * F.lit(share)).cast("int")).alias(name) for name, share in shares.items()
        ]
        names = [*by, "count", "sum", "min", "max", "mean"]
        return known.groupBy(*by).agg(*basic, sorted_).select(*names, *picks)
    picked = ranks.order_statistics(
        df, by, value, {name: F.floor(n * F.lit(share)) for name, share in shares.items()}
    ).drop("n")
    return known.groupBy(*by).agg(*basic).join(picked, by)


def metric_key(name: Column, labels: Column) -> Column:
    """Metric name with its labels in sorted order."""
    entries = F.array_sort(F.map_entries(labels))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)


def counters_and_gauges(metrics: DataFrame) -> DataFrame:
    """Counter totals and latest gauges by name and labels.

    ``metrics`` has ``name``, ``kind``, ``labels``, ``ts``, ``value`` and an
    ``id`` that breaks ties in time.
    """
    keyed = metrics.withColumn("key", metric_key(F.col("name"), F.col("labels")))
    return keyed.groupBy("kind", "key").agg(
        F.when(F.first("kind") == "counter", F.sum("value"))
        .otherwise(F.max(F.struct("ts", "id", "value"))["value"])
        .alias("value")
    )


def load_report(log: DataFrame) -> DataFrame:
    """Extremes, mean, quantiles and success share of a load test, one row."""
    timed = log.filter(F.col("latency_ms").isNotNull())
    quantile = ranks.quantiles(timed, [], "latency_ms", QUANTILES).drop("n")
    basic = log.agg(
        F.count(F.lit(1)).alias("requests"),
        F.min("latency_ms").alias("min_ms"),
        F.avg("latency_ms").alias("avg_ms"),
        F.max("latency_ms").alias("max_ms"),
        (F.avg((~_is("error")).cast("int")) * 100).alias("success_percent"),
    )
    quantile_columns = F.struct(*[F.col(c) for c in quantile.columns])
    return basic.withColumn("_q", quantile.select(quantile_columns).scalar()).select(*basic.columns, "_q.*")


SEVERITY = {"healthy": 0, "unknown": 1, "degraded": 1, "unhealthy": 2}


def health_rollup(checks: DataFrame, by: list[str]) -> DataFrame:
    """Worst state of a set of checks; unknown counts as degraded."""
    code = F.coalesce(*[F.when(F.col("state") == s, F.lit(c)) for s, c in SEVERITY.items()], F.lit(1))
    return checks.groupBy(*by).agg(
        F.when(F.max(code) == 2, "unhealthy").when(F.max(code) == 1, "degraded").otherwise("healthy").alias("overall"),
        F.count(F.lit(1)).alias("checks"),
    )


def top_errors(errors: DataFrame, count: int = 10) -> DataFrame:
    """Most frequent pairs of error type and component."""
    return (
        errors.groupBy("error_type", "component")
        .agg(F.count(F.lit(1)).alias("errors"))
        .orderBy(F.desc("errors"), "error_type", "component")
        .limit(count)
    )


def component_error_rate(rows: DataFrame, size: str = "5 minutes", time: str = "ts") -> DataFrame:
    """Errors per component and window: count, per second and share of rows."""
    keyed = rows.withColumn("window", F.window(time, size))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return (
        keyed.groupBy("window", "component")
        .agg(
            F.count_if(F.col("error_type").isNotNull()).alias("errors"),
            F.avg(F.col("error_type").isNotNull().cast("int")).alias("error_share"),
        )
        .withColumn("errors_per_second", F.col("errors") / seconds)
    )


def ingestion_lag(messages: DataFrame, size: str = "5 minutes", limit_seconds: float = 60.0) -> DataFrame:
    """Lag, message rate and error rate per source and window."""
    lag = (F.unix_micros("processed_at") - F.unix_micros("event_time")) / 1000000.0
    keyed = messages.withColumn("window", F.window("processed_at", size))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return (
        keyed.groupBy("window", "source")
        .agg(
            F.max(lag).alias("max_lag_seconds"),
            (F.count(F.lit(1)) / F.first(seconds)).alias("messages_per_second"),
            (F.count_if("failed") / F.first(seconds)).alias("errors_per_second"),
        )
        .withColumn("lagging", F.col("max_lag_seconds") > limit_seconds)
    )


def latency_heatmap(log: DataFrame, edges: tuple[float, ...] = HISTOGRAM_EDGES) -> DataFrame:
    """Requests per minute and latency bucket; the bucket is its upper edge."""
    seconds = F.col("latency_ms") / 1000.0
    edge = reduce(
        lambda chain, e: F.when(seconds <= e, F.lit(f"{e:g}")) if chain is None else chain.when(seconds <= e, F.lit(f"{e:g}")),
        edges,
        None,
    ).otherwise("+Inf")
    return (
        log.filter(F.col("latency_ms").isNotNull())
        .groupBy(F.window(TIME, "1 minute"), edge.alias("le"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def feature_requests(requests: DataFrame) -> DataFrame:
    """Store requests per group and operation."""
    return requests.groupBy("feature_group", "operation").agg(F.count(F.lit(1)).alias("requests"))


def model_load_time(loads: DataFrame) -> DataFrame:
    """Mean load time per model."""
    return loads.groupBy("model_name").agg(F.avg("load_seconds").alias("avg_load_seconds"))


def business_outcomes(joined: DataFrame) -> DataFrame:
    """Fraud caught and missed, false alarms and money saved per model."""
    flagged, fraud = F.col("predicted") == 1, F.col("actual") == 1
    return joined.groupBy("model_name").agg(
        F.count_if(flagged & fraud).alias("fraud_detected"),
        F.count_if(flagged & ~fraud).alias("false_positives"),
        F.count_if(~flagged & fraud).alias("false_negatives"),
        F.sum(F.when(flagged & fraud, F.col("amount")).otherwise(0.0)).alias("money_saved"),
    )


def last_predictions(log: DataFrame, count: int = 10000) -> DataFrame:
    """Newest ``count`` rows of the log per model."""
    return latest_per_key(log, ["model_name"], [F.col(TIME).desc(), F.col("request_id").desc()], count)


def prediction_outcome(predictions: DataFrame, outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """Predictions beside what really happened, one outcome per request."""
    single = outcomes.groupBy(key).agg(F.max("actual").alias("actual"))
    return predictions.join(single, key)


