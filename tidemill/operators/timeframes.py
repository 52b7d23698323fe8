"""Calendar windows and trailing windows over events.

Trailing windows do not use sliding ``rangeBetween`` frames over events, which
recompute each row's frame and keep a user in one task. Time is cut into
one-hour slots instead, and a user's rows spread over the slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemill.operators import ranks
from tidemill.session import materialize, work_path

DAY = 86400
SLOT_MICROS = 3600 * 1000000


def hourly(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Volume and spread of amounts per hour."""
    return df.groupBy(F.window(time, "1 hour")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.stddev_pop("amount").alias("std_amount"),
    )


def daily(df: DataFrame, time: str = "event_time", merchant: str = "merchant_category") -> DataFrame:
    """Volume and number of merchants per day."""
    return df.groupBy(F.window(time, "1 day")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.count_distinct(merchant).alias("unique_merchants"),
    )


def weekly(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Volume per week and the slope of the amount over time in days."""
    days = F.unix_micros(time) / (DAY * 1000000.0)
    return df.groupBy(F.window(time, "7 days")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.regr_slope(F.col("amount"), days).alias("amount_trend"),
    )


def per_merchant(df: DataFrame, time: str = "event_time", merchant: str = "merchant_category") -> DataFrame:
    """Volume, users and mean amount per merchant and day."""
    return df.groupBy(F.window(time, "1 day"), merchant).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.avg("amount").alias("avg_amount"),
    )


def user_day(df: DataFrame, time: str = "event_wall") -> DataFrame:
    """Batch grouping by user and calendar date."""
    return df.groupBy("user_id", F.to_date(time).alias("date")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
    )


def _slot(micros):
    return F.floor(micros / F.lit(SLOT_MICROS))


#: Instants of one key in one hour above which the hour is split.
CELL_INSTANTS = 65_536
#: Width of the parts of such an hour in microseconds, and so the most instants of a part.
PART_MICROS = 8192
#: Frame lengths that a block of rows holds; one in so many rows is copied to the next block.
HALO_BLOCKS = 16


def _narrow(df: DataFrame, key: str, time: str, *columns: Column) -> DataFrame:
    """Key, instant in microseconds and the given columns, written once, so that the source is read once."""
    return materialize(
        df.select(key, F.unix_micros(time).alias("_at"), *columns), work_path(df.sparkSession, "timeframe")
    )


def _crowded(instants: DataFrame, key: str, limit: int) -> DataFrame | None:
    """Hours of a key with more than ``limit`` instants: key, _slot; none is the common case."""
    cells = instants.groupBy(key, _slot(F.col("_at")).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    crowded = materialize(cells.filter(F.col("_n") > limit).drop("_n"), work_path(instants.sparkSession, "crowded"))
    return None if crowded.isEmpty() else crowded


_MERGE = {
    F.sum: lambda a, b: F.coalesce(a + b, a, b),
    F.max: F.greatest,
}


def within_slots(
    rows: DataFrame, key: str, totals: dict[str, tuple], crowded: DataFrame | None
) -> DataFrame:
    """Running totals over ``_at`` within each (key, _slot).

    ``totals`` maps an output name to (``F.sum`` or ``F.max``, column, whether it
    runs backward). An hour in ``crowded`` is cut into parts of ``PART_MICROS``,
    which hold no more instants than that; totals of its parts, of which an hour
    has a fixed number at most, are carried across them.
    """

    def windows(*by: str, order: str):
        whole = W.partitionBy(*by)
        return {False: whole.orderBy(order), True: whole.orderBy(F.desc(order))}

    def local(frame: DataFrame, *by: str) -> DataFrame:
        along = windows(*by, order="_at")
        return frame.withColumns(
            {
                name: how(column).over(along[backward].rowsBetween(W.unboundedPreceding, W.currentRow))
                for name, (how, column, backward) in totals.items()
            }
        )

    if crowded is None:
        return local(rows, key, "_slot")
    marked = ranks.null_safe_join(rows, crowded.withColumn("_crowded", F.lit(True)), [key, "_slot"], "left")
    calm = local(marked.filter(F.col("_crowded").isNull()), key, "_slot").drop("_crowded")
    split = marked.filter("_crowded").drop("_crowded").withColumn("_part", F.floor(F.col("_at") / PART_MICROS))
    cells = [key, "_slot", "_part"]
    parts = split.groupBy(*cells).agg(*[how(column).alias(name) for name, (how, column, _) in totals.items()])
    along = windows(key, "_slot", order="_part")
    carried = parts.select(
        *cells,
        *[
            how(name).over(along[backward].rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_{name}")
            for name, (how, _, backward) in totals.items()
        ],
    )
    inside = ranks.null_safe_join(local(split, *cells), carried, cells)
    full = inside.withColumns(
        {name: _MERGE[how](F.col(f"_c_{name}"), F.col(name)) for name, (how, _, _) in totals.items()}
    )
    return calm.unionByName(full.select(*calm.columns))


def trailing(
    instants: DataFrame, key: str, hours: dict[str, int], limit: int = CELL_INSTANTS
) -> DataFrame:
    """Count, sum and maximum over ``[t - hours, t]`` per key and instant ``_at``.

    ``instants`` has the key, ``_at`` in microseconds and ``_amount``. A frame is
    the rest of the slot it starts in, the whole slots between, and the current
    slot so far. The first part is read by shifting that slot's events forward so
    that they share a group with the instants that need them; one pass over the
    rows yields them as they are and once per window. The second part comes from
    one row per slot. Nothing is subtracted, so the sums carry no cancellation
    error. Hours with more than ``limit`` instants are split into finer parts.
    """
    moments = instants.groupBy(key, "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_s"), F.max("_amount").alias("_x")
    )
    measures = ("_n", "_s", "_x")
    shifts = {"own": 0, **{name: span * SLOT_MICROS for name, span in hours.items()}}
    copies = F.explode(F.array(*[F.struct(F.lit(name).alias("of"), F.lit(by).alias("by")) for name, by in shifts.items()]))
    copied = moments.withColumn("_copy", copies).select(
        key,
        (F.col("_at") + F.col("_copy.by")).alias("_at"),
        *[F.when(F.col("_copy.of") == name, F.col(m)).alias(f"{m}_{name}") for name in shifts for m in measures],
    )
    columns = [f"{m}_{name}" for name in shifts for m in measures]
    merged = copied.groupBy(key, _slot(F.col("_at")).alias("_slot"), "_at").agg(*[F.max(c).alias(c) for c in columns])
    # Every copy of an hour's instants is moved by whole hours, so an hour of the
    # merged rows holds no more than the hours that it is made of together.
    found = _crowded(moments, key, max(1, limit // len(shifts)))
    moved = F.explode(F.array(*[F.col("_slot") + by // SLOT_MICROS for by in shifts.values()]))
    crowded = None if found is None else found.select(key, moved.alias("_slot")).distinct()
    totals = {"_head_n": (F.sum, "_n_own", False), "_head_s": (F.sum, "_s_own", False), "_head_x": (F.max, "_x_own", False)}
    for name in hours:
        totals |= {f"_tail_n_{name}": (F.sum, f"_n_{name}", True), f"_tail_s_{name}": (F.sum, f"_s_{name}", True)}
        totals |= {f"_tail_x_{name}": (F.max, f"_x_{name}", True)}
    edges = within_slots(merged, key, totals, crowded).filter(F.col("_n_own").isNotNull())
    slots = instants.groupBy(key, _slot(F.col("_at")).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_s"), F.max("_amount").alias("_x")
    )
    middle = {}
    for name, span in hours.items():
        if span < 2:
            middle.update({f"_mid_{m}_{name}": F.lit(None).cast("double") for m in "nsx"})
            continue
        between = W.partitionBy(key).orderBy("_slot").rangeBetween(-(span - 1), -1)
        middle[f"_mid_n_{name}"] = F.sum("_n").over(between)
        middle[f"_mid_s_{name}"] = F.sum("_s").over(between)
        middle[f"_mid_x_{name}"] = F.max("_x").over(between)
    framed = edges.join(slots.select(key, "_slot", *[c.alias(n) for n, c in middle.items()]), [key, "_slot"])

    def total(m: str, name: str):
        parts = [f"_head_{m}", f"_mid_{m}_{name}", f"_tail_{m}_{name}"]
        if m == "x":
            return F.greatest(*parts)
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in parts])

    return framed.select(
        key,
        "_at",
        *[total("n", name).cast("bigint").alias(f"count_{name}") for name in hours],
        *[total("s", name).alias(f"sum_{name}") for name in hours],
        *[total("x", name).alias(f"max_{name}") for name in hours],
    )


def distinct_marks(instants: DataFrame, key: str, item: str, hours: int) -> DataFrame:
    """Births and deaths of items: their running total is the number alive.

    An item is alive from its first event until ``hours`` after its last one,
    as long as no gap is wider. Events of one slot never break an item's life,
    so the first and last instant per slot are all that is needed.
    """
    span = hours * SLOT_MICROS
    per_slot = (
        instants.groupBy(key, item, _slot(F.col("_at")).alias("_slot"))
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    order = W.partitionBy(key, item).orderBy("_slot")
    lives = per_slot.withColumns(
        {"_before": F.lag("_last").over(order), "_after": F.lead("_first").over(order)}
    )
    opens = F.col("_before").isNull() | (F.col("_first") - F.col("_before") > span)
    closes = F.col("_after").isNull() | (F.col("_after") - F.col("_last") > span)
    marks = F.array_compact(
        F.array(
            F.when(opens, F.struct(F.col("_first").alias("at"), F.lit(1).alias("n"))),
            F.when(closes, F.struct((F.col("_last") + F.lit(span + 1)).alias("at"), F.lit(-1).alias("n"))),
        )
    )
    return (
        lives.select(key, F.explode(marks).alias("_mark"))
        .groupBy(key, F.col("_mark.at").alias("_at"))
        .agg(F.sum("_mark.n").alias("_n"))
    )


def per_user_30d(
    df: DataFrame,
    key: str = "user_id",
    items: dict[str, str] | None = None,
    days: int = 30,
    time: str = "event_time",
    amount: str = "amount",
    limit: int = CELL_INSTANTS,
) -> DataFrame:
    """Count, total, mean, maximum and item variety over the trailing days.

    One row per key and instant at which the key had an event. The source is
    read once; all parts go on from its instants, amounts and items.
    """
    items = items or {}
    kept = {name: f"_item_{i}" for i, name in enumerate(items)}
    instants = _narrow(
        df, key, time, F.col(amount).alias("_amount"), *[F.col(items[name]).alias(c) for name, c in kept.items()]
    )
    result = trailing(instants.select(key, "_at", "_amount"), key, {"frame": days * 24}, limit)
    if items:
        # The instants themselves join the marks with a weight of zero, so that
        # each gets the running total of all marks up to and including it.
        marks = instants.select(key, "_at", F.lit(True).alias("_here"), *[F.lit(0).alias(f"_d_{n}") for n in items])
        for name, item in kept.items():
            lives = distinct_marks(instants, key, item, days * 24)
            marks = marks.unionByName(
                lives.select(
                    key,
                    "_at",
                    F.lit(False).alias("_here"),
                    *[(F.col("_n") if other == name else F.lit(0)).alias(f"_d_{other}") for other in items],
                )
            )
        merged = marks.groupBy(key, _slot(F.col("_at")).alias("_slot"), "_at").agg(
            F.max("_here").alias("_here"), *[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in items]
        )
        merged = materialize(merged, work_path(df.sparkSession, "timeframe-marks"))
        in_slot = within_slots(
            merged, key, {n: (F.sum, f"_d_{n}", False) for n in items}, _crowded(merged, key, limit)
        ).filter("_here")
        slots = merged.groupBy(key, "_slot").agg(*[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in items])
        earlier = W.partitionBy(key).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
        before = slots.select(
            key, "_slot", *[F.coalesce(F.sum(f"_d_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in items]
        )
        alive = in_slot.join(before, [key, "_slot"]).select(
            key, "_at", *[(F.col(f"_b_{n}") + F.col(n)).alias(n) for n in items]
        )
        result = result.join(alive, [key, "_at"])
    return result.select(
        key,
        F.timestamp_micros("_at").alias(time),
        F.col("count_frame").alias("transaction_count"),
        F.col("sum_frame").alias("total_amount"),
        (F.col("sum_frame") / F.col("count_frame")).alias("avg_amount"),
        F.col("max_frame").alias("max_amount"),
        *items,
    )


# Velocity windows in hours.
VELOCITY_HOURS = {"1h": 1, "24h": 24, "7d": 168}


def velocity(
    df: DataFrame,
    key: str = "user_id",
    time: str = "event_time",
    amount: str = "amount",
    limit: int = CELL_INSTANTS,
) -> DataFrame:
    """Transactions and money per hour over three trailing windows."""
    instants = _narrow(df, key, time, F.col(amount).alias("_amount"))
    frames = trailing(instants, key, VELOCITY_HOURS, limit)
    return frames.select(
        key,
        F.timestamp_micros("_at").alias(time),
        *[(F.col(f"count_{n}") / h).alias(f"transaction_rate_{n}") for n, h in VELOCITY_HOURS.items()],
        *[(F.col(f"sum_{n}") / h).alias(f"amount_rate_{n}") for n, h in VELOCITY_HOURS.items()],
    )


def zscore_last_rows(
    df: DataFrame,
    key: str,
    value: str,
    order: list[str],
    rows: int = 1000,
    min_std: float = 1e-8,
) -> DataFrame:
    """Z-score against the last ``rows`` rows of the same key, current row included.

    Rows get a position by their place in ranges of (key, order). Blocks of
    ``HALO_BLOCKS`` times ``rows`` positions are then windowed together with the
    ``rows - 1`` rows before them, so no task sorts a whole key, every frame sees
    all its rows, and few rows are copied. Frame sums are differences of running
    sums of values centred on their block, which keeps them linear in the rows
    and free of large cancellations. ``order`` starts with a timestamp and
    identifies a row.
    """
    numbered = row_positions(df, key, order)
    size = rows * HALO_BLOCKS
    block = F.floor((F.col("_position") - 1) / size)
    in_halo = F.col("_position") - block * size > size - rows + 1
    places = F.when(in_halo, F.array(block, block + 1)).otherwise(F.array(block))
    pairs = numbered.withColumns({"_home": block, "_block": F.explode(places)})
    group = W.partitionBy(key, "_block")
    ordered = group.orderBy("_position")
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    centred = pairs.withColumn("_d", F.col(value) - F.avg(value).over(group))
    sums = centred.withColumns(
        {"_s1": F.sum("_d").over(upto), "_s2": F.sum(F.col("_d") * F.col("_d")).over(upto)}
    ).withColumns(
        {
            "_s1": F.col("_s1") - F.coalesce(F.lag("_s1", rows).over(ordered), F.lit(0.0)),
            "_s2": F.col("_s2") - F.coalesce(F.lag("_s2", rows).over(ordered), F.lit(0.0)),
            "_n": F.least(F.col("_position"), F.lit(rows)),
        }
    )
    mean = F.col("_s1") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_s2") / F.col("_n") - mean * mean, F.lit(0.0)))
    return (
        sums.filter(F.col("_block") == F.col("_home"))
        .withColumn(f"{value}_zscore", (F.col("_d") - mean) / F.greatest(spread, F.lit(min_std)))
        .select(*df.columns, f"{value}_zscore")
    )


def _number(key: str):
    """Adds the range and the place of a row among its key's rows in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, reached = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index(key))
            codes = own.dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            place = np.arange(1, len(codes) + 1) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
            if last is not None and own[0].as_py() == last:
                until = begins[1] if len(begins) > 1 else len(codes)
                place[:until] += reached
            last, reached = own[-1].as_py(), int(place[-1])
            columns = [*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(place)]
            yield pa.record_batch(columns, names=[*batch.schema.names, "_range", "_place"])

    return run


def row_positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One-based position of each row within its key in ``order``, counted across ranges of (key, order)."""
    schema = StructType([*df.schema.fields, StructField("_range", IntegerType()), StructField("_place", LongType())])
    ranges = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = materialize(ranges.mapInArrow(_number(key), schema), work_path(df.sparkSession, "positions"))
    counts = placed.groupBy(key, "_range").agg(F.max("_place").alias("_rows"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        ranks.null_safe_join(placed, offsets, [key, "_range"])
        .withColumn("_position", F.col("_offset") + F.col("_place"))
        .drop("_range", "_place", "_offset")
    )
