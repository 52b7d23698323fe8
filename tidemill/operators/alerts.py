"""Alert rules over metric series: held conditions and notification state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.session import materialize, work_path


@dataclass(frozen=True)
class AlertRule:
    """A SQL condition over a metric row and how long it must hold."""

    name: str
    condition: str
    hold_minutes: int
    severity: str = "warning"


# The published alert rules over one row per step.
ALERT_RULES = (
    AlertRule("HighErrorRate", "error_rate > 0.05", 5),
    AlertRule("HighPredictionLatency", "p95 > 0.5", 5),
    AlertRule("CriticalPredictionLatency", "p95 > 1.0", 2, "critical"),
    AlertRule("ModelAPIDown", "up = 0", 1, "critical"),
    AlertRule("LowCacheHitRate", "cache_hit_rate < 0.5", 10),
    AlertRule("NoPredictions", "requests = 0", 10),
)


def fill_steps(series: DataFrame, step: str, time: str = "step") -> DataFrame:
    """Add the steps that have no row, with null metrics.

    The spine runs over the time range of the series, one row per step. Its days
    are dealt out before each becomes steps, so no row holds the whole range.
    """
    bounds = series.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).filter(F.col("lo").isNotNull())
    days = bounds.select(
        "lo", "hi", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("_day")
    ).repartition("_day")
    last = F.least(F.col("hi"), F.col("_day") + F.expr(f"INTERVAL 1 DAY - INTERVAL {step}"))
    spine = days.select(F.explode(F.sequence("_day", last, F.expr(f"INTERVAL {step}"))).alias(time))
    return spine.join(series, time, "left")


def held_alerts(
    series: DataFrame, rules: tuple[AlertRule, ...] = ALERT_RULES, time: str = "step", block: str = "1 day"
) -> DataFrame:
    """One row per stretch of steps in which a rule's condition holds.

    ``firing`` says whether the stretch is long enough, ``fired_at`` when it
    became so. Stretches are found within each rule's time blocks, which are
    tasks of their own; a pass over one summary row per block then joins what
    the borders of blocks have cut.
    """
    evaluations = series.select(
        F.col(time).alias("_at"),
        F.window(time, block)["start"].alias("_block"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(rule.name).alias("alert"),
                        F.lit(rule.severity).alias("severity"),
                        F.lit(rule.hold_minutes).alias("hold_minutes"),
                        F.coalesce(F.expr(rule.condition), F.lit(False)).alias("met"),
                    )
                    for rule in rules
                ]
            )
        ).alias("e"),
    ).select("_at", "_block", "e.*")
    keys = ["alert", "severity", "hold_minutes", "_block"]
    within = W.partitionBy(*keys).orderBy("_at")
    # The misses before a met step number its stretch within the block.
    marked = evaluations.withColumn("_misses", F.count_if(~F.col("met")).over(within))
    pieces = marked.groupBy(*keys, "_misses").agg(
        F.min(F.when(F.col("met"), F.col("_at"))).alias("from"),
        F.max(F.when(F.col("met"), F.col("_at"))).alias("to"),
        F.count_if("met").alias("steps"),
    )
    blocks = pieces.groupBy(*keys).agg(
        F.max("_misses").alias("_misses"),
        # Stretches at the block's start and end; the others are whole.
        F.max(F.when(F.col("_misses") == 0, F.struct("from", "to", "steps"))).alias("_head"),
        F.max(F.struct("_misses", "from", "to", "steps")).alias("_tail"),
        F.collect_list(F.when(F.col("steps") > 0, F.struct("_misses", "from", "to", "steps"))).alias("_pieces"),
    )
    along = W.partitionBy("alert", "severity", "hold_minutes").orderBy("_block")
    open_before = F.coalesce(F.lag(F.col("_tail.steps") > 0).over(along), F.lit(False))
    joins = open_before & (F.coalesce(F.col("_head.steps"), F.lit(0)) > 0)
    # A chain goes on into a block that it fills or at whose start it ends.
    begins = F.when(joins & (F.col("_misses") == 0), F.lit(0)).otherwise(F.lit(1))
    chained = blocks.select(*keys, "_misses", "_pieces", joins.alias("_joins"), F.sum(begins).over(along).alias("_chain"))
    piece = chained.select(
        "alert", "severity", "hold_minutes", "_block", "_chain", "_joins", F.col("_misses").alias("_last"), F.explode("_pieces").alias("p")
    ).select("*", "p.*")
    tail = F.col("_misses") == F.col("_last")
    chain = (
        # What joins the block before belongs to that block's chain, what ends a block to its own.
        F.when((F.col("_misses") == 0) & F.col("_joins") & ~tail, F.col("_chain") - 1).when(tail, F.col("_chain"))
    )
    own = F.when(chain.isNull(), F.struct("_block", "_misses"))
    stretches = (
        piece.groupBy("alert", "severity", "hold_minutes", chain.alias("_chain"), own.alias("_own"))
        .agg(F.min("from").alias("started_at"), F.max("to").alias("last_at"), F.sum("steps").alias("steps"))
        .drop("_chain", "_own")
    )
    due = F.col("started_at") + F.make_dt_interval(mins=F.col("hold_minutes"))
    return stretches.select(
        "alert",
        "severity",
        "started_at",
        "last_at",
        "steps",
        (F.col("last_at") >= due).alias("firing"),
        F.when(F.col("last_at") >= due, due).alias("fired_at"),
    )


def metric_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metric values that break a threshold row.

    ``thresholds`` has ``alert``, ``metric``, ``comparison`` (``<`` or ``>``)
    and ``threshold``; the join is on the metric's name.
    """
    joined = metrics.join(thresholds, F.col("name") == F.col("metric"))
    broken = F.when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).otherwise(
        F.col("value") > F.col("threshold")
    )
    return joined.filter(broken).select("alert", "name", "ts", "value", "threshold")


# Metric thresholds of the alert configuration.
METRIC_THRESHOLDS = (
    ("model_accuracy_drop", "accuracy", "<", 0.85),
    ("data_drift_detected", "drift_score", ">", 0.1),
    ("consumer_lag_high", "consumer_lag", ">", 10000.0),
    ("stream_error_rate_high", "stream_error_rate", ">", 0.01),
    ("cache_miss_rate_high", "cache_miss_rate", ">", 0.3),
)


STATE_SCHEMA = (
    "alert string, ts timestamp, met boolean, status string, trigger_count bigint, "
    "notified boolean, first_triggered timestamp, last_notified timestamp, resolved_at timestamp"
)


@dataclass
class Carry:
    """What one alert's past means for its next evaluation."""

    active: bool = False
    count: int = 0
    first: pd.Timestamp = pd.NaT
    notified: pd.Timestamp = pd.NaT
    resolved: pd.Timestamp = pd.NaT


def _last(marks: np.ndarray) -> np.ndarray:
    """Position of the last mark up to each row, -1 before the first."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


def advance(
    rows: pd.DataFrame, carry: Carry, cooldown: pd.Timedelta, auto_resolve: bool
) -> tuple[pd.DataFrame, Carry]:
    """States after evaluations of one alert in time order, and what to carry on.

    An episode is a run of met evaluations. It is broken by a suppression and,
    with ``auto_resolve``, by one that is not met; the values of the last episode
    stay until the next begins. A notice goes out at the first met evaluation
    and then at the first one after each cooldown, across episodes.
    """
    ts, met, hidden = rows["ts"].reset_index(drop=True), rows["met"].to_numpy(bool), rows["suppressed"].to_numpy(bool)
    live = met & ~hidden
    breaks = hidden | (~met if auto_resolve else np.zeros(len(met), bool))
    last_live, last_break = _last(live), _last(breaks)
    active = np.where((last_live < 0) & (last_break < 0), carry.active, last_live > last_break)
    before = np.concatenate([[carry.active], active[:-1]])
    begun = _last(live & ~before)
    running = np.cumsum(live)
    count = np.where(begun >= 0, running - running[begun] + 1, carry.count + running)
    ended = _last(breaks & ~hidden & before)

    def at(position: np.ndarray, known: np.ndarray, otherwise) -> pd.Series:
        return ts.take(np.maximum(position, 0)).reset_index(drop=True).where(known, otherwise)

    first = at(begun, begun >= 0, carry.first)
    fresh = np.where(begun >= 0, pd.NaT, carry.resolved)
    resolved = at(ended, ended > begun, pd.Series(pd.to_datetime(fresh)))
    candidates, notices = np.flatnonzero(live), np.zeros(len(live), bool)
    times, place, latest = ts.to_numpy()[candidates], 0, carry.notified
    while True:
        if not pd.isna(latest):
            place = int(np.searchsorted(times, (latest + cooldown).to_datetime64()))
        if place >= len(times):
            break
        notices[candidates[place]] = True
        latest = pd.Timestamp(times[place])
        if cooldown <= pd.Timedelta(0):
            notices[candidates], latest = True, pd.Timestamp(times[-1])
            break
    told = _last(notices)
    out = pd.DataFrame(
        {
            "alert": rows["alert"].to_numpy(),
            "ts": ts,
            "met": met,
            "status": np.select([hidden, active], ["suppressed", "active"], "resolved"),
            "trigger_count": count,
            "notified": notices,
            "first_triggered": first,
            "last_notified": at(told, told >= 0, carry.notified),
            "resolved_at": resolved,
        }
    )
    return out, Carry(bool(active[-1]), int(count[-1]), first.iloc[-1], latest, resolved.iloc[-1])


#: Evaluations of one alert that a block holds.
BLOCK_ROWS = 16_384
_EFFECT = "active boolean, begun boolean, count bigint, first timestamp, settled boolean, resolved timestamp"
_BLOCKS = (
    "alert string, block bigint, starts timestamp, ts array<timestamp>, met array<boolean>, suppressed array<boolean>, "
    f"idle struct<{_EFFECT}>, running struct<{_EFFECT}>, entries array<timestamp>, exits array<timestamp>"
)
_ENTRY = "block bigint, active boolean, count bigint, first timestamp, notified timestamp, resolved timestamp"


def _effect(rows: pd.DataFrame, active: bool, auto_resolve: bool) -> dict:
    """What a block does to the state of an alert that enters it idle or active, whatever its values are."""
    unknown = pd.Timestamp(0)
    out, carry = advance(rows, Carry(active, 0, unknown, pd.NaT, unknown), pd.Timedelta(0), auto_resolve)
    live = rows["met"].to_numpy(bool) & ~rows["suppressed"].to_numpy(bool)
    before = np.concatenate([[active], out["status"].to_numpy()[:-1] == "active"])
    begun = bool((live & ~before).any())
    return {
        "active": carry.active,
        "begun": begun,
        "count": carry.count,
        "first": carry.first if begun else None,
        "settled": begun or carry.resolved != unknown,
        "resolved": None if pd.isna(carry.resolved) or carry.resolved == unknown else carry.resolved,
    }


def _notices(rows: pd.DataFrame, cooldown: pd.Timedelta) -> tuple[np.ndarray, np.ndarray]:
    """Last notice of a block by the first evaluation that may give one.

    Whoever enters has its last notice before the block, so it is free again
    within one cooldown; only evaluations up to there are entries. Entries with
    the same outcome are one: the last of them.
    """
    live = rows["met"].to_numpy(bool) & ~rows["suppressed"].to_numpy(bool)
    times = rows["ts"].to_numpy()[live]
    if not len(times):
        return times, times
    if cooldown <= pd.Timedelta(0):
        return times[-1:], times[-1:]
    following = np.searchsorted(times, times + cooldown.to_timedelta64()).tolist()
    final = list(range(len(times)))
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            final[i] = final[following[i]]
    reach = int(np.searchsorted(times, rows["ts"].iloc[0].to_datetime64() + cooldown.to_timedelta64()))
    outcome = np.array(final[: reach + 1])
    kept = np.append(outcome[1:] != outcome[:-1], True)
    return times[: reach + 1][kept], times[outcome[kept]]


def _cut(cooldown: pd.Timedelta, auto_resolve: bool, block_rows: int):
    """Blocks of a sorted range, each with what it does to the states that may enter it."""

    def block(number: int, alert: str | None, rows: pd.DataFrame) -> pd.DataFrame:
        entries, exits = _notices(rows, cooldown)
        values = {"alert": alert, "block": number, "starts": rows["ts"].iloc[0]}
        values |= {name: rows[name].tolist() for name in ("ts", "met", "suppressed")}
        values |= {"idle": _effect(rows, False, auto_resolve), "running": _effect(rows, True, auto_resolve)}
        values |= {"entries": list(pd.to_datetime(entries)), "exits": list(pd.to_datetime(exits))}
        return pd.DataFrame({name: [value] for name, value in values.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            for alert, rows in batch.groupby("alert", sort=False, dropna=False):
                alert = None if pd.isna(alert) else alert
                if held is not None and held[0] != alert:
                    yield block(number, *held)
                    number, held = number + 1, None
                rows = rows if held is None else pd.concat([held[1], rows])
                while len(rows) >= block_rows:
                    yield block(number, alert, rows.iloc[:block_rows].reset_index(drop=True))
                    number, rows = number + 1, rows.iloc[block_rows:]
                held = (alert, rows.reset_index(drop=True)) if len(rows) else None
        if held is not None:
            yield block(number, *held)

    return run


def _compose(cooldown: pd.Timedelta):
    """The state with which each block is entered, from one row per block in time order."""

    def plain(value) -> pd.Timestamp:
        return pd.NaT if value is None else pd.Timestamp(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, carry = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples():
                alert = None if pd.isna(row.alert) else row.alert
                if carry is None or alert != current:
                    current, carry = alert, Carry()
                out.append((row.block, carry.active, carry.count, carry.first, carry.notified, carry.resolved))
                effect = row.running if carry.active else row.idle
                entries = [pd.Timestamp(x) for x in row.entries]
                at = 0 if pd.isna(carry.notified) else bisect_left(entries, carry.notified + cooldown)
                carry = Carry(
                    effect["active"],
                    effect["count"] if effect["begun"] else carry.count + effect["count"],
                    plain(effect["first"]) if effect["begun"] else carry.first,
                    pd.Timestamp(row.exits[at]) if at < len(entries) else carry.notified,
                    plain(effect["resolved"]) if effect["settled"] else carry.resolved,
                )
            frame = pd.DataFrame(out, columns=["block", "active", "count", "first", "notified", "resolved"])
            yield frame.astype({name: "datetime64[us]" for name in ("first", "notified", "resolved")})

    return run


def _fill(cooldown: pd.Timedelta, auto_resolve: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rows = pd.DataFrame({"ts": pd.to_datetime(row.ts), "met": row.met, "suppressed": row.suppressed})
                rows["alert"] = row.alert
                carry = Carry(bool(row.active), int(row.count_), row.first, row.notified, row.resolved)
                yield advance(rows, carry, cooldown, auto_resolve)[0]

    return run


def ordered_evaluations(evaluations: DataFrame) -> DataFrame:
    """``alert``, ``ts``, ``met`` and ``suppressed``, with unknown flags as false."""
    hidden = F.col("suppressed") if "suppressed" in evaluations.columns else F.lit(False)
    return evaluations.select(
        "alert",
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce("met", F.lit(False)).alias("met"),
        F.coalesce(hidden, F.lit(False)).alias("suppressed"),
    ).filter(F.col("ts").isNotNull())


def alert_states(
    evaluations: DataFrame, cooldown_minutes: int = 15, auto_resolve: bool = True, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """State after every evaluation, from ``alert``, ``ts``, ``met`` and ``suppressed``.

    Notice times depend on each other along an alert, which is a scan. It runs
    in parallel: evaluations are range-partitioned by alert and time and cut into
    blocks; each block yields what it does to a state that enters it (both ways
    an episode may come in, and the last notice for every evaluation that may
    give the first one); one row per block is then composed in time order, and
    the blocks are filled in with the states they are entered with. So an alert
    of any length is spread over tasks. Evaluations without a time have no place
    in the order and no state; of those at one time, unmet ones come first.
    """
    spark = evaluations.sparkSession
    cooldown = pd.Timedelta(minutes=cooldown_minutes)
    order = ["alert", "ts", "suppressed", "met"]
    ordered = ordered_evaluations(evaluations).repartitionByRange("alert", "ts").sortWithinPartitions(*order)
    blocks = materialize(ordered.mapInPandas(_cut(cooldown, auto_resolve, block_rows), _BLOCKS), work_path(spark, "alert-blocks"))
    summaries = blocks.select("alert", "block", "starts", "idle", "running", "entries", "exits")
    entered = (
        summaries.repartition("alert")
        .sortWithinPartitions("alert", "starts", "block")
        .mapInPandas(_compose(cooldown), _ENTRY)
        .withColumnRenamed("count", "count_")
    )
    # Blocks are dealt out anew: a broadcast of the small side could leave them where the alert's states are.
    filled = blocks.select("alert", "block", "ts", "met", "suppressed").join(entered.hint("shuffle_hash"), "block").drop("block")
    return filled.mapInPandas(_fill(cooldown, auto_resolve), STATE_SCHEMA)
