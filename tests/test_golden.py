"""Golden input and output pairs, and edge rows the tables do not hold."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemill.config import FRAUD_DETECTOR, ValidationRules
from tidemill.functions import transforms as T
from tidemill.operators import alerts as A
from tidemill.operators import labeling as L
from tidemill.operators import monitor as M
from tidemill.operators import ranks
from tidemill.operators import store as S
from tidemill.operators.extract import errors_of, extract_features, features_of
from tidemill.operators.joins import dedup_first
from tidemill.operators.validate import validate_features
from tidemill.functions.payload import decode_payload

NOW = "2024-02-01 00:00:00"


def apply(spark, transform, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", transform(F.col("v"), kind).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_numeric(spark):
    scaled = T.Numeric(0, 100, normalize=True)
    assert apply(spark, scaled, ["50", "-10", "150", None, ""]) == [0.5, 0.0, 1.0, 0.0, 0.0]
    assert apply(spark, T.Numeric(), ["not_a_number", "1.5d"]) == [0.0, 0.0]
    assert apply(spark, T.Numeric(fill=False), [None]) == [None]
    assert math.isnan(apply(spark, T.Numeric(0, 5), [float("nan")], "double")[0])


def test_categorical(spark):
    colors = T.Categorical(("red", "green", "blue"), encode=True)
    assert apply(spark, colors, ["red", "GREEN", "yellow", None]) == [0, 1, 3, 3]
    exact = T.Categorical(("Red",), encode=True, exact_keys=True)
    assert apply(spark, exact, ["red"]) == [1]


def test_datetime(spark):
    parts = apply(spark, T.DateTime("components"), ["2023-06-15 14:30:00"])[0]
    assert (parts["year"], parts["month"], parts["day"], parts["hour"]) == (2023, 6, 15, 14)
    assert apply(spark, T.DateTime("iso"), ["02/03/2024", "25/03/2024"]) == [
        "2024-02-03T00:00:00",
        "2024-03-25T00:00:00",
    ]


def test_boolean(spark):
    words = ["true", "yes", "1", "false", "no", "0", None, "whatever"]
    assert apply(spark, T.Boolean(numeric=True), words) == [1, 1, 1, 0, 0, 0, 0, 1]


def test_text(spark):
    assert apply(spark, T.Text(max_length=10, plain=True), ["  Hello World!  ", None, ""]) == ["hello worl", "", ""]


def test_histogram(spark):
    df = spark.createDataFrame([("m", float(v)) for v in range(1, 6)], "name string, v double")
    row = M.histogram_stats(df, ["name"], "v").first()
    assert (row["count"], row["sum"], row["min"], row["max"], row["mean"]) == (5, 15.0, 1.0, 5.0, 3.0)
    assert (row["p50"], row["p90"], row["p99"]) == (3.0, 5.0, 5.0)


def test_label_rule_golden(spark):
    rows = [("cash_advance", 23, 1500.0), ("cash_advance", 2, 500.0), ("jewelry", 3, 600.0), ("grocery", 12, 50.0)]
    df = spark.createDataFrame(rows, "merchant_category string, hour_of_day int, amount double")
    assert [r["label"] for r in L.rule_based(df, noise_std=0.0).collect()] == [1, 1, 1, 0]


def test_label_noise_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("message_id"), F.lit("cash_advance").alias("merchant_category"))
    one = L.rule_based(df.coalesce(1), ids=("message_id",)).orderBy("message_id").collect()
    many = L.rule_based(df.repartition(7), ids=("message_id",)).orderBy("message_id").collect()
    assert one == many


def test_feature_statistics(spark):
    rows = [(str(i), 1.0, 2.0, 3.0) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id string, a double, b double, c double")
    store = S.upsert(spark.createDataFrame([], S.STORE_SCHEMA), S.pack_features(df, "g", processing_time=NOW))
    stats = S.group_statistics(store).collect()
    assert {(r["unique_entities"], r["row_count"], r["total_features"], r["feature_count"]) for r in stats} == {(4, 4, 12, 4)}


def test_upsert_brings_a_deleted_row_back(spark):
    df = spark.createDataFrame([("u", 1)], "user_id string, a int")
    batch = S.pack_features(df, "g", processing_time=NOW)
    store = S.upsert(spark.createDataFrame([], S.STORE_SCHEMA), batch)
    gone = S.delete(store, store.select(*S.KEY))
    assert gone.first()["is_active"] is False
    assert S.upsert(gone, batch).first()["is_active"] is True


def test_quoted_text_survives_the_store(spark):
    text = 'say "hi" \\ back\nnew line'
    df = spark.createDataFrame([("u", text)], "user_id string, a string")
    store = S.upsert(spark.createDataFrame([], S.STORE_SCHEMA), S.pack_features(df, "g", processing_time=NOW))
    assert S.wide_features(store, "g", ["a"], numeric=[]).first()["a"] == text


def test_alert_cooldown_and_resolve(spark):
    start = dt.datetime(2024, 1, 1)
    met = [True, True, False, True, True]
    rows = [("a", start + dt.timedelta(minutes=5 * i), m) for i, m in enumerate(met)]
    df = spark.createDataFrame(rows, "alert string, ts timestamp, met boolean")
    out = A.alert_states(df, cooldown_minutes=15).orderBy("ts").collect()
    assert [r["status"] for r in out] == ["active", "active", "resolved", "active", "active"]
    assert [r["trigger_count"] for r in out] == [1, 2, 2, 1, 2]
    assert [r["notified"] for r in out] == [True, False, False, True, False]


def test_held_alert_needs_its_time(spark):
    start = dt.datetime(2024, 1, 1)
    rates = [0.1, 0.0, 0.1, 0.1, 0.1]
    rows = [(start + dt.timedelta(minutes=5 * i), v) for i, v in enumerate(rates)]
    df = spark.createDataFrame(rows, "step timestamp, error_rate double")
    out = A.held_alerts(df, (A.AlertRule("e", "error_rate > 0.05", 10),)).orderBy("started_at").collect()
    assert [(r["steps"], r["firing"]) for r in out] == [(1, False), (3, True)]
    assert out[1]["fired_at"] == start + dt.timedelta(minutes=20)


def test_order_statistics_against_brute_force(spark):
    values = [(k, ((i * 7919) % 101) * (-1 if i % 4 == 0 else 1) / 7.0) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(values, "k string, v double")
    out = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", {"q": 0.37, "m": 0.5}).collect()}
    for key in "ab":
        ordered = sorted(v for k, v in values if k == key)
        for name, q in (("q", 0.37), ("m", 0.5)):
            at = (len(ordered) - 1) * q
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert out[key][name] == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_running_totals_with_equal_values(spark):
    df = spark.createDataFrame([("a", v, 1) for v in (1, 1, 2, 900, 900, 5000)], "k string, v int, n int")
    out = ranks.running_totals(df, ["k"], ranks.magnitude_bucket(F.col("v")), "v", {"t": "n"}).orderBy("v").collect()
    assert [r["t"] for r in out] == [2, 2, 3, 5, 5, 6]


def test_extraction_edges(spark):
    docs = [
        '{"user_id":"u","amount":"  12.5 ","timestamp":"2024-01-01T23:00:00+05:00"}',
        '{"user_id":null,"amount":null,"timestamp":"2024-01-06T22:30:00Z","is":1}',
        '{"user_id":"u","risk_score":"nan","timestamp":"2024-01-01"}',
        '{"user_id":"u","account_age_days":"3.5"}',
        '{"data":null}',
        '{"data":[1]}',
        '{"timestamp":5}',
        "[1, 2]",
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, value string")
    out = extract_features(df, "value", NOW, keep=("i",))
    good = {r["i"]: r for r in features_of(out).collect()}
    assert set(good) == {0, 1, 2, 7}
    assert good[0]["amount"] == 12.5 and good[0]["hour_of_day"] == 23
    assert good[0]["event_time"] == dt.datetime(2024, 1, 1, 18)
    assert good[1]["user_id"] is None and good[1]["amount"] is None and good[1]["is_night"] and good[1]["is_weekend"]
    assert good[2]["risk_score"] == 0.0 and good[2]["user_id"] == "u"
    assert good[7]["user_id"] == "unknown" and good[7]["amount"] == 0.0 and good[7]["year"] == 2024
    errors = [r["error"] for r in errors_of(out, NOW).collect()]
    assert len(errors) == 4 and "invalid literal for int() with base 10: '3.5'" in errors


def test_payload_forms(spark):
    values = [b'{"a":1}', b"plain", b"\xff\xfe", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value binary")
    out = [r["d"] for r in df.orderBy("i").select(decode_payload(F.col("value")).alias("d")).collect()]
    assert out == ['{"a":1}', '{"raw_data":"plain"}', '{"raw_data_b64":"//4="}', '{"raw_data":null}']


def test_validation_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (11.0,)], "amount double")
    rules = ValidationRules(ranges={"amount": (0, 10)})
    assert [r["is_valid"] for r in validate_features(df, rules).collect()] == [True, True, False]


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("unknown", 3), ("unknown", 4)], "message_id string, event_time int")
    assert sorted(tuple(r) for r in dedup_first(df).collect()) == [("a", 1), ("unknown", 3)]


def test_model_definition_order():
    assert FRAUD_DETECTOR.columns[3] == "transaction_count_24h"
    assert FRAUD_DETECTOR.mapping_for("transaction_count_24h").source == "record_count"
