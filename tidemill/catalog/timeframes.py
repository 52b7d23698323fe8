"""Calendar and trailing windows."""

from __future__ import annotations

from tidemill.catalog.registry import FEAT, TX, bucket, features, query, r7, with_
from tidemill.operators import timeframes as T


def _edges(seconds: int) -> str:
    return f"{bucket(seconds)} AS window_from, {bucket(seconds)} + INTERVAL '{seconds} seconds' AS window_to"


@query(
    "hourly",
    with_(
        TX,
        f"""SELECT {_edges(3600)}, count(*) AS transaction_count, {r7('sum(amount)')} AS total_amount,
             {r7('avg(amount)')} AS avg_amount, {r7('max(amount)')} AS max_amount, {r7('stddev_pop(amount)')} AS std_amount
           FROM tx GROUP BY ALL""",
    ),
)
def hourly(spark, folder):
    return T.hourly(features(spark, folder))


@query(
    "daily",
    with_(
        TX,
        f"""SELECT {_edges(86400)}, count(*) AS transaction_count, {r7('sum(amount)')} AS total_amount,
             {r7('avg(amount)')} AS avg_amount, count(DISTINCT merchant_category) AS unique_merchants
           FROM tx GROUP BY ALL""",
    ),
)
def daily(spark, folder):
    return T.daily(features(spark, folder))


@query(
    "weekly",
    with_(
        TX,
        f"""SELECT {_edges(604800)}, count(*) AS transaction_count, {r7('sum(amount)')} AS total_amount,
             {r7('regr_slope(amount, epoch(ts) / 86400)')} AS amount_trend FROM tx GROUP BY ALL""",
    ),
)
def weekly(spark, folder):
    return T.weekly(features(spark, folder))


@query(
    "per_user_30d",
    with_(
        f"{TX}, moments AS (SELECT DISTINCT user_id, ts FROM tx)",
        f"""SELECT a.user_id, a.ts AS event_time, count(*) AS transaction_count, {r7('sum(t.amount)')} AS total_amount,
             {r7('avg(t.amount)')} AS avg_amount, {r7('max(t.amount)')} AS max_amount,
             count(DISTINCT t.channel) AS unique_merchants, count(DISTINCT t.merchant_category) AS unique_categories
           FROM moments a JOIN tx t ON t.user_id = a.user_id AND t.ts <= a.ts AND t.ts >= a.ts - INTERVAL 30 DAY
           GROUP BY ALL""",
    ),
)
def per_user_30d(spark, folder):
    """Trailing thirty days at every event."""
    items = {"unique_merchants": "channel", "unique_categories": "merchant_category"}
    return T.per_user_30d(features(spark, folder), items=items)


@query(
    "per_user_2d",
    with_(
        f"{TX}, moments AS (SELECT DISTINCT user_id, ts FROM tx)",
        f"""SELECT a.user_id, a.ts AS event_time, count(*) AS transaction_count, {r7('sum(t.amount)')} AS total_amount,
             {r7('avg(t.amount)')} AS avg_amount, {r7('max(t.amount)')} AS max_amount,
             count(DISTINCT t.channel) AS unique_merchants, count(DISTINCT t.merchant_category) AS unique_categories
           FROM moments a JOIN tx t ON t.user_id = a.user_id AND t.ts <= a.ts AND t.ts >= a.ts - INTERVAL 2 DAY
           GROUP BY ALL""",
    ),
)
def per_user_2d(spark, folder):
    """The same with two days, which most events fall out of again."""
    items = {"unique_merchants": "channel", "unique_categories": "merchant_category"}
    return T.per_user_30d(features(spark, folder), items=items, days=2)


def _velocity_sql() -> str:
    parts = []
    for name, hours in T.VELOCITY_HOURS.items():
        inside = f"FILTER (WHERE t.ts >= a.ts - INTERVAL {hours} HOUR)"
        parts.append(f"{r7(f'count(*) {inside} / {hours}.0::DOUBLE')} AS transaction_rate_{name}")
        parts.append(f"{r7(f'sum(t.amount) {inside} / {hours}.0::DOUBLE')} AS amount_rate_{name}")
    return ", ".join(parts)


@query(
    "velocity",
    with_(
        f"{TX}, moments AS (SELECT DISTINCT user_id, ts FROM tx)",
        f"""SELECT a.user_id, a.ts AS event_time, {_velocity_sql()}
           FROM moments a JOIN tx t ON t.user_id = a.user_id AND t.ts <= a.ts AND t.ts >= a.ts - INTERVAL 168 HOUR
           GROUP BY ALL""",
    ),
)
def velocity(spark, folder):
    return T.velocity(features(spark, folder))


@query(
    "per_merchant_24h",
    with_(
        TX,
        f"""SELECT {_edges(86400)}, merchant_category, count(*) AS transaction_count,
             count(DISTINCT user_id) AS unique_users, {r7('avg(amount)')} AS avg_amount FROM tx GROUP BY ALL""",
    ),
)
def per_merchant_24h(spark, folder):
    return T.per_merchant(features(spark, folder))


@query(
    "batch_user_day",
    with_(
        TX,
        f"""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS transaction_count,
             {r7('sum(amount)')} AS total_amount, {r7('avg(amount)')} AS avg_amount, {r7('max(amount)')} AS max_amount
           FROM tx GROUP BY ALL""",
    ),
)
def batch_user_day(spark, folder):
    return T.user_day(features(spark, folder))


@query(
    "zscore_roll",
    with_(
        FEAT,
        f"""SELECT message_id, merchant_category,
             {r7("(amount - avg(amount) OVER w) / greatest(stddev_pop(amount) OVER w, 1e-8)")} AS amount_zscore
           FROM feat WINDOW w AS (PARTITION BY merchant_category ORDER BY ts, message_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
    ),
)
def zscore_roll(spark, folder):
    """Against the last thousand rows of the same merchant category."""
    rows = features(spark, folder).select("message_id", "merchant_category", "event_time", "amount")
    return T.zscore_last_rows(rows, "merchant_category", "amount", ["event_time", "message_id"]).select(
        "message_id", "merchant_category", "amount_zscore"
    )
