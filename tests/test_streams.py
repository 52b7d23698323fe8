"""Streaming sources and state: offsets, sketches of fixed size, merged keys."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import ENTRY_DIR
from tidemill.catalog.streams import JOB_SETTINGS
from tidemill.config import WindowSpec
from tidemill.operators.aggregate import DISTINCT_ERROR
from tidemill.sinks.keyed import KeyedTable
from tidemill.sources import adapters
from tidemill.sources.recorded import read_recorded, record_topics
from tidemill.streaming.job import finish, read_table_stream, start_feature_job, start_file_query
from tidemill.streaming.windows import aggregate_stream

START = dt.datetime(2024, 1, 1)


def records(spark, first, last, topic="t"):
    return spark.range(first, last).select(
        F.col("id").cast("string").cast("binary").alias("key"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id")).cast("binary")).alias("value"),
        F.lit(topic).alias("topic"),
        (F.col("id") % 3).cast("int").alias("partition"),
        F.col("id").alias("offset"),
        F.timestamp_seconds("id").alias("timestamp"),
    )


def run(spark, root, starting, topics=("t",), **options):
    stream = read_recorded(spark, f"{root}/log", list(topics), starting, **options)
    start_file_query(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def test_recorded_topics_without_loss_or_repeats(spark, tmp_path):
    root = str(tmp_path)
    record_topics(records(spark, 0, 100), f"{root}/log")
    record_topics(records(spark, 0, 9, "other"), f"{root}/log")
    assert run(spark, root, "earliest").count() == 100
    assert run(spark, root, "earliest").count() == 100  # nothing new
    record_topics(records(spark, 100, 150), f"{root}/log")
    record_topics(records(spark, 150, 170), f"{root}/log")
    found = run(spark, root, "earliest")
    want = records(spark, 0, 170).withColumn("timestampType", F.lit(0))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))


def test_latest_begins_behind_what_is_there(spark, tmp_path):
    root = str(tmp_path)
    record_topics(records(spark, 0, 50), f"{root}/log")
    assert run(spark, root, "latest").count() == 0
    new = records(spark, 50, 60).withColumn("partition", F.when(F.col("offset") == 59, 7).otherwise(F.col("partition")))
    record_topics(new, f"{root}/log")
    assert sorted(r.offset for r in run(spark, root, "latest").collect()) == list(range(50, 60))


def test_no_topic_yet_and_wrong_options(spark, tmp_path):
    assert run(spark, str(tmp_path), "earliest", ["absent"]).count() == 0
    with pytest.raises(Exception, match="latest or earliest"):
        run(spark, str(tmp_path / "x"), "sometime")


def aggregates(spark, root, rows, summaries):
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    out = aggregate_stream(stream, WindowSpec("fixed", "1 day"), summaries=summaries)
    start_file_query(out, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def state_bytes(root):
    return sum(p.stat().st_size for p in (root / "checkpoint" / "state").rglob("*") if p.suffix in (".delta", ".snapshot", ".zip", ".changelog"))


def event_rows(spark, n):
    """One user and day with n amounts and shops, and a later row that closes it."""
    rows = spark.range(n).select(
        F.lit("u").alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 86400).alias("event_time"),
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e3).alias("amount"),
        F.concat(F.lit("shop"), F.col("id")).alias("merchant_category"),
    )
    later = rows.limit(1).withColumn("event_time", F.to_timestamp(F.lit("2024-02-01")))
    return rows.unionByName(later).withColumn("timestamp", F.col("event_time").cast("string")).repartition(3)


def test_sketch_state_does_not_grow_with_a_window_and_keeps_its_bounds(spark, tmp_path):
    sizes = {}
    for n in (2_000, 60_000):
        root = tmp_path / f"s{n}"
        rows = event_rows(spark, n)
        found = aggregates(spark, str(root), rows, "sketch").collect()
        assert [r.record_count for r in found] == [n]
        assert abs(found[0].unique_merchants - n) <= 4 * DISTINCT_ERROR * n
        below = rows.filter(F.col("event_time") < "2024-01-20").agg(F.avg((F.col("amount") <= found[0].median_amount).cast("int"))).first()[0]
        assert abs(below - 0.5) <= 0.01
        sizes[n] = state_bytes(root)
    exact = tmp_path / "exact"
    aggregates(spark, str(exact), event_rows(spark, 60_000), "exact")
    assert sizes[60_000] < 1.5 * sizes[2_000] and state_bytes(exact) > 5 * sizes[60_000]


def test_sketch_state_of_small_windows_is_small(spark, tmp_path):
    """Two rows a window: sketches of full size would take kilobytes for each."""
    rows = spark.range(0, 10_000, 1, 3).select(
        F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 86400).alias("event_time"),
        F.col("id").cast("double").alias("amount"),
        F.when(F.col("id") % 2 == 0, "shop").alias("merchant_category"),
        F.lit("t").alias("timestamp"),
    )
    later = rows.limit(1).withColumn("event_time", F.to_timestamp(F.lit("2024-02-01")))
    rows.unionByName(later).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = aggregate_stream(stream, WindowSpec("fixed", "1 day"), summaries="sketch")
    query = start_file_query(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert len(found) == 5000 and {(r.unique_merchants, r.unique_channels) for r in found} == {(2, 1)}
    used = max(s["memoryUsedBytes"] for p in query.recentProgress for s in p["stateOperators"])
    assert used / 5000 < 4000


def test_no_windowing_writes_changed_users_only(spark, tmp_path):
    schema = "user_id string, event_time timestamp, amount double, timestamp string"
    batches = [[(f"u{i}", START, float(i), "t") for i in range(200)], [("u7", START, 100.0, "t"), (None, START, 1.0, "t")]]
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    seen, written = [], []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = aggregate_stream(stream, WindowSpec("none"))
        before = files()
        query = start_file_query(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode="update")
        query.awaitTermination()
        written.append(len(set(files()) - set(before)))
        seen.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    assert seen == [200, 2] and written[1] <= 2 < written[0]
    found = {r.user_id: r for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    assert len(found) == 201 and found["u7"].record_count == 2 and found["u7"].total_amount == 107.0
    assert math.isclose(found["u7"].median_amount, 53.5) and found["unknown"].record_count == 1


def test_a_repeated_merge_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), "a string, b int, v double", ["a", "b"], buckets=4)
    rows = spark.createDataFrame([("x", 1, 1.0), (None, 2, 2.0), ("y", None, 3.0)], "a string, b int, v double")
    table.merge(rows)
    table.merge(rows.withColumn("v", F.col("v") * 10))
    table.merge(rows.withColumn("v", F.col("v") * 10))
    table.merge(rows.limit(0))
    assert sorted(r.v for r in table.read().collect()) == [10.0, 20.0, 30.0]


def test_job_extracts_documents_once(spark, tmp_path):
    """The aggregates stream from the features that were written; a second run adds nothing."""
    out, found = f"{tmp_path}/out", []
    for _ in range(2):
        source = adapters.raw_documents(read_table_stream(spark, ENTRY_DIR, "events"))
        queries = start_feature_job(source, out, f"{tmp_path}/checkpoint", JOB_SETTINGS, "value")
        finish(queries)
        names = [p["sources"][0]["description"] for p in queries[1].recentProgress]
        assert all(f"{out}/features" in name for name in names) and (names or found)
        found.append([spark.read.parquet(f"{out}/{name}").count() for name in ("features", "aggregated_features")])
    assert found[0] == found[1] and min(found[0]) > 0
