"""Jobs from the command line, model definitions, and edges of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.catalog.registry import NOW, features
from tidemill.config import FRAUD_DETECTOR, WindowSpec, read_models
from tidemill.jobs import main
from tidemill.operators.aggregate import assign_sessions, window_column
from tidemill.operators.alerts import AlertRule, alert_states, fill_steps, held_alerts
from tidemill.operators.explore import label_codes
from tidemill.operators.joins import dedup_first
from tidemill.operators.quality import type_ranges
from tidemill.operators.ranks import order_statistics, quantiles
from tidemill.operators.store import FeatureTable
from tidemill.operators.training import search_grid, estimator, with_class_weights

DEFINITION = """
model_name: "{name}"
features: {{columns: ["amount", "volume", "channel_code"], target: "label"}}
beam_mapping:
  per_record_fields: {{amount: "amount"}}
  aggregated_fields: {{volume: {{source_field: "record_count"}}}}
  transforms: {{channel_code: {{type: "hash_encode", source_field: "channel", modulo: 7}}}}
"""


@pytest.fixture
def definitions(tmp_path):
    folder = tmp_path / "models"
    folder.mkdir()
    (folder / "one.yaml").write_text(DEFINITION.format(name="one"))
    settings = {"model_name": "two", "features": {"columns": ["hour"]}, "beam_mapping": {"per_record_fields": {"hour": "hour_of_day"}}}
    (folder / "two.json").write_text(json.dumps(settings))
    return str(folder)


def test_models_from_files(spark, definitions):
    models = read_models(spark, definitions)
    assert set(models) == {"one", "two"}
    assert models["one"].mapping_for("channel_code").modulo == 7
    assert models["one"].mapping_for("volume").source == "record_count"
    assert models["two"].columns == ("hour",) and models["two"].target == "label"


def test_jobs_from_events_to_metrics(spark, folder, definitions, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    lines = features(spark, folder).select(
        "message_id", "user_id", "amount", "merchant_category", "payment_method", "channel", F.col("event_time").cast("string").alias("timestamp")
    )
    lines.write.json(str(tmp_path / "events"))
    main(["features", "--input", str(tmp_path / "events"), "--output", str(tmp_path / "f"), "--processing-time", NOW], spark)
    assert spark.read.json(str(tmp_path / "f/features")).count() == events.count()
    common = ["--models", definitions, "--model-name", "one"]
    main(["assemble", "--features", str(tmp_path / "f/features"), "--output", str(tmp_path / "t"), "--noise", "0", *common], spark)
    table = str(tmp_path / "t.parquet")
    assert spark.read.parquet(table).columns == ["amount", "volume", "channel_code", "label"]
    main(["train", "--input", table, "--output", str(tmp_path / "m"), "--kind", "logistic_regression", *common], spark)
    main(["evaluate", "--input", table, "--model", str(tmp_path / "m"), "--output", str(tmp_path / "e"), *common], spark)
    assert 0.5 < spark.read.json(str(tmp_path / "e")).first()["accuracy"] <= 1


def test_narrow_values_are_cut_into_small_parts(spark):
    rows = spark.range(60000).select((F.lit(1.7e9) + F.col("id") % 50000).alias("v"))
    found = quantiles(rows, [], "v", {"m": 0.5}).first()
    want = sorted(1.7e9 + i % 50000 for i in range(60000))
    assert found["m"] == (want[29999] + want[30000]) / 2
    text = order_statistics(rows, [], "v", {"r": F.lit(30000)})._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in text


def test_any_number_of_classes(spark):
    rows = spark.range(12000).select(F.col("id").alias("label"))
    assert with_class_weights(rows.unionAll(rows)).filter("weight = 1").count() == 24000


def test_search_takes_as_many_trials_as_asked():
    assert len(search_grid("random_forest", estimator("random_forest"), 25)) == 25
    assert len(search_grid("random_forest", estimator("random_forest"), 100)) == 27


def test_events_a_whole_gap_apart_are_two_sessions(spark):
    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 00:19:59")], "user_id string, t string")
    rows = rows.select("user_id", F.to_timestamp("t").alias("event_time"))
    batch = {tuple(r["window"]) for r in assign_sessions(rows, "10 minutes").collect()}
    spec = WindowSpec("session", gap="10 minutes")
    stream = {tuple(r["window"]) for r in rows.groupBy("user_id", window_column(spec, "event_time").alias("window")).count().collect()}
    assert len(batch) == 2 and batch == stream


def test_only_full_iso_times_pass(spark):
    texts = ["2024-01-02T03:04:05", "12:30", "2024", "2024-01-02", "yesterday", None]
    rows = spark.createDataFrame([(i, "1", t) for i, t in enumerate(texts)], "i int, amount string, timestamp string")
    found = {r["i"]: r["timestamp_is_iso"] for r in type_ranges(rows, ["i"]).collect()}
    assert found == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False}


def test_ties_are_settled_by_content(spark):
    rows = [("a", 1, f"v{i}") for i in range(50)]
    found = {
        dedup_first(spark.createDataFrame(rows[::step], "message_id string, event_time int, v string").repartition(n)).first()["v"]
        for step, n in ((1, 1), (-1, 7), (1, 13))
    }
    assert len(found) == 1


def test_codes_follow_the_order_of_values(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("äx",), ("b2",)], "v string")
    assert {r["v"]: r["v_code"] for r in label_codes(rows, "v").collect()} == {"a": 0, "b": 1, "b2": 2, "äx": 3, None: None}


STORE_ROW = "entity_id string, feature_group string, features map<string,string>, event_timestamp timestamp, ingestion_timestamp timestamp, ttl_timestamp timestamp, is_active boolean, _order struct<n:int>"


def store_batch(spark, *rows):
    """Rows of entity, group, features, day and day of expiry."""
    at = lambda day: __import__("datetime").datetime(2024, 1, day)
    return spark.createDataFrame([(e, g, f, at(d), at(d), at(t), True, (i,)) for i, (e, g, f, d, t) in enumerate(rows)], STORE_ROW)


def stored_files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_expiry_returns_its_count_and_leaves_other_partitions(spark, tmp_path):
    path = tmp_path / "store"
    table = FeatureTable(spark, str(path), parts=4)
    table.upsert(store_batch(spark, ("a", "g", {"x": "1"}, 1, 2), ("b", "g", {"x": "1"}, 1, 9), ("a", "h", {"x": "1"}, 1, 9)), 1)
    before = stored_files(path)
    assert table.expire("2024-01-05 00:00:00") == 1
    assert table.expire("2024-01-05 00:00:00") == 0
    assert table.read().filter("is_active").count() == 2
    changed = {f for f in set(stored_files(path)) - set(before)}
    assert len(changed) == 1 and all("feature_group=g" in f for f in changed)


def test_only_touched_partitions_are_written_and_repeats_change_nothing(spark, tmp_path):
    path = tmp_path / "store"
    table = FeatureTable(spark, str(path), parts=8)
    table.upsert(store_batch(spark, *[(f"e{i}", g, {"x": str(i)}, 1, 9) for i in range(60) for g in ("g", "h")]), 1)
    before = stored_files(path)
    second = store_batch(spark, ("e5", "g", {"y": "2"}, 2, 9), ("e5", "g", {"x": "7"}, 3, 9), ("new", "g", {"x": "0"}, 2, 9))
    table.upsert(second, 2)
    after = stored_files(path)
    assert 1 <= len(set(after) - set(before)) <= 2 and len(set(before) - set(after)) <= 2
    state = lambda: sorted(map(str, table.read().collect()))
    settled = state()
    row = table.read().filter("entity_id = 'e5' and feature_group = 'g'").first()
    assert row.features == {"x": "7", "y": "2"} and row.ingestion_timestamp.day == 3
    # A batch that comes again, and one that comes late after a newer one, are settled by their numbers.
    table.upsert(second, 2)
    table.upsert(store_batch(spark, ("e5", "g", {"x": "old"}, 1, 9)), 1)
    assert state() == settled
    table.upsert(store_batch(spark, ("e5", "g", {"x": "unnumbered"}, 4, 9)))
    assert table.read().filter("features['x'] = 'unnumbered'").count() == 1
    table.delete(store_batch(spark, ("e5", "g", {}, 1, 9)))
    assert table.read().filter("not is_active").select("entity_id", "feature_group").collect() == [("e5", "g")]
    assert table.read().count() == 121


def test_service_down_and_steps_over_days(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:05:00", 0), ("2024-01-01 00:10:00", 0), ("2024-01-04 12:00:00", 1)], "t string, up int")
    series = fill_steps(rows.select(F.to_timestamp("t").alias("step"), "up"), "5 minutes")
    assert series.count() == series.select("step").distinct().count() == 3 * 288 + 144 + 1
    held = held_alerts(series, (AlertRule("down", "up = 0", 1, "critical"),)).collect()
    assert [(r["steps"], r["firing"]) for r in held] == [(2, True)]


def test_suppression_keeps_values_and_ends_an_episode(spark):
    met, hidden = [1, 1, 0, 1, 1, 1, 0, 1], [0, 0, 0, 0, 1, 0, 0, 0]
    rows = [("a", i, bool(m), bool(h)) for i, (m, h) in enumerate(zip(met, hidden))]
    frame = spark.createDataFrame(rows, "alert string, i int, met boolean, suppressed boolean")
    frame = frame.withColumn("ts", F.timestamp_seconds(F.col("i") * 60)).drop("i")
    out = alert_states(frame, cooldown_minutes=3).orderBy("ts").collect()
    assert [r["status"][0] for r in out] == list("aarasara")
    assert [r["trigger_count"] for r in out] == [1, 2, 2, 1, 1, 1, 1, 1]
    assert [r["notified"] for r in out] == [True, False, False, True, False, False, False, True]
    assert [r["resolved_at"] is not None for r in out] == [False, False, True, False, False, False, True, False]
