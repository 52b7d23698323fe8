"""Trailing frames and rolling scores against plain loops, where one key or hour holds everything."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import timeframes as T

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id string, event_time timestamp, amount double, shop string, id long"


def events(seed, n, spread):
    rng = random.Random(seed)
    users = ["hot"] * 6 + ["a", "b"]
    return [
        (rng.choice(users), START + dt.timedelta(microseconds=rng.randrange(spread)), round(rng.uniform(1, 99), 2), rng.choice("xyz"), i)
        for i in range(n)
    ]


def frames(rows, hours):
    out = {}
    for user, at in {r[:2] for r in rows}:
        own = [r for r in rows if r[0] == user and at - dt.timedelta(hours=hours) <= r[1] <= at]
        out[user, at] = (len(own), sum(r[2] for r in own), max(r[2] for r in own), len({r[3] for r in own}))
    return out


@pytest.mark.parametrize("spread", [3 * 86_400_000_000, 3_600_000_000, 60_000, 40])
@pytest.mark.parametrize("limit", [2, T.CELL_INSTANTS])
def test_trailing_frames(spark, spread, limit):
    """From three days down to all rows in forty instants of one hour, split or not."""
    rows = events(spread % 97, 300, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = T.per_user_30d(df, items={"shops": "shop"}, days=1, limit=limit).collect()
    want = frames(rows, 24)
    assert len(got) == len(want)
    for r in got:
        n, total, most, shops = want[r.user_id, r.event_time]
        assert (r.transaction_count, r.max_amount, r.shops) == (n, most, shops)
        assert math.isclose(r.total_amount, total, rel_tol=1e-9) and math.isclose(r.avg_amount, total / n, rel_tol=1e-9)
    rates = {h: frames(rows, h) for h in (1, 24, 168)}
    for r in T.velocity(df, limit=limit).collect():
        for name, h in T.VELOCITY_HOURS.items():
            n, total, *_ = rates[h][r.user_id, r.event_time]
            assert math.isclose(r[f"transaction_rate_{name}"], n / h) and math.isclose(r[f"amount_rate_{name}"], total / h, rel_tol=1e-9)


def test_one_key_and_one_hour_are_many_tasks(spark):
    """No window holds more than a part of the hour that has all rows."""
    df = spark.range(40_000).select(
        F.lit("hot").alias("user_id"), (F.col("id") * 80_000).alias("_at"), F.lit(1.0).alias("_amount")
    )
    crowded = T._crowded(df, "user_id", 1000)
    assert crowded.count() == 1
    rows = df.withColumn("_slot", F.floor(F.col("_at") / T.SLOT_MICROS)).withColumn("_own", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = T.within_slots(rows, "user_id", {"upto": (F.sum, "_own", False), "after": (F.sum, "_own", True)}, crowded)
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        wrong = found.filter((F.col("upto") != F.col("_at") / 80_000 + 1) | (F.col("after") != 40_000 - F.col("_at") / 80_000))
        assert wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 10_000


def test_the_source_is_read_once(spark, tmp_path):
    spark.createDataFrame(events(1, 50, 10**9), SCHEMA).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    for frame in (T.per_user_30d(source, items={"shops": "shop"}), T.velocity(source)):
        assert "source" not in " ".join(frame.inputFiles())


@pytest.mark.parametrize("rows", [1, 5, 40])
def test_zscore_of_last_rows(spark, rows):
    data = events(9, 900, 40) + [(None, START, 5.0, "x", 1000 + i) for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r.id: r.amount_zscore for r in T.zscore_last_rows(df, "user_id", "amount", ["event_time", "id"], rows).collect()}
    assert len(got) == len(data)
    for user in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == user), key=lambda r: (r[1], r[4]))
        for i, r in enumerate(own):
            frame = [x[2] for x in own[max(0, i - rows + 1) : i + 1]]
            mean = sum(frame) / len(frame)
            spread = math.sqrt(sum((x - mean) ** 2 for x in frame) / len(frame))
            if spread > 1e-6:
                assert math.isclose(got[r[4]], (r[2] - mean) / spread, rel_tol=1e-6, abs_tol=1e-6)


def test_few_rows_are_copied(spark):
    """One key: 40 000 rows in frames of 100 are copied less than once in ten."""
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.timestamp_micros("id").alias("t"), "id", F.rand(1).alias("v"))
    scored = T.zscore_last_rows(df, "k", "v", ["t", "id"], 100)
    plan = scored._jdf.queryExecution()
    assert scored.count() == 40_000
    scored.collect()
    nodes = plan.executedPlan().toString()
    assert "Generate explode" in nodes
    numbered = T.row_positions(df, "k", ["t", "id"])
    size = 100 * T.HALO_BLOCKS
    copies = numbered.filter(F.col("_position") - F.floor((F.col("_position") - 1) / size) * size > size - 99).count()
    assert copies < 0.1 * 40_000
    assert numbered.filter(F.col("_position") != F.col("id") + 1).isEmpty()


def test_codes_of_values_with_a_common_beginning(spark):
    """All values begin alike; their order is still found in many tasks."""
    from tidemill.operators.explore import label_codes

    urls = spark.range(20_000).select(F.concat(F.lit("https://example.com/a/very/long/path/"), F.sha2(F.col("id").cast("string"), 256)).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = T.row_positions(urls.withColumn("_all", F.lit(0)), "_all", ["v"])
        places = placed.select("_position").distinct().count()
        counts = urls.repartitionByRange("v").groupBy(F.spark_partition_id()).count().collect()
        codes = {r.v: r.v_code for r in label_codes(urls, "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert places == 20_000 and len(counts) == 8 and max(r["count"] for r in counts) < 5_000
    assert [v for v, _ in sorted(codes.items(), key=lambda x: x[1])] == sorted(codes)
    assert sorted(codes.values()) == list(range(20_000))
