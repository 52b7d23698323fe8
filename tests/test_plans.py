"""Plans must keep the shape that survives large and skewed data."""

import random

from pyspark.sql import functions as F

from tidemill.catalog.registry import features
from tidemill.config import WindowSpec
from tidemill.operators.aggregate import aggregate_users
from tidemill.operators.alerts import STATE_SCHEMA
from tidemill.operators.joins import dedup_first, latest_per_key
from tidemill.operators.ranks import quantiles
from tidemill import catalog
from tidemill.session import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.sum("l_tax"))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan(rows)


def test_first_row_is_cut_below_the_shuffle(spark, folder):
    text = plan(dedup_first(features(spark, folder), "message_id", ("event_time",)))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text


def test_quantiles_never_group_a_crowded_key_in_one_task(spark, folder):
    """Groups up to a fixed number of rows are aggregated at once, larger ones never."""
    events = table(spark, folder, "events")
    spread = plan(quantiles(events, ["event_type"], "value", {"m": 0.5}, calm_rows=0))
    assert "percentile" not in spread and "collect" not in spread
    both = plan(quantiles(events, ["event_type"], "value", {"m": 0.5}, calm_rows=10))
    assert "percentile" in both and "isnull(_crowded" in both
    calm = plan(quantiles(events, ["event_type"], "value", {"m": 0.5}))
    assert calm.count("Exchange hashpartitioning") == 1 and calm.count("FileScan") == 1


def test_user_aggregates_collect_calm_groups_only(spark, folder):
    both = plan(aggregate_users(features(spark, folder), WindowSpec("fixed", "1 day"), calm_rows=1))
    assert "LeftAnti" in both and "LeftSemi" in both
    calm = plan(aggregate_users(features(spark, folder), WindowSpec("fixed", "1 day")))
    assert calm.count("Exchange hashpartitioning") == 1 and calm.count("FileScan") == 1
    for word in ("collect_list", "BroadcastNestedLoopJoin", "CartesianProduct", "Python"):
        assert word not in both and word not in calm


def test_sessions_and_frames_read_their_source_once(spark, folder):
    sessions = plan(aggregate_users(features(spark, folder), WindowSpec("session", gap="6 hours")))
    assert sessions.count("Exchange hashpartitioning") <= 5 and "events.parquet" not in sessions
    for name in ("per_user_30d", "velocity"):
        assert "events.parquet" not in plan(catalog.queries()[name](spark, folder))


def test_large_limits_rank_salted_first(spark):
    random.seed(1)
    rows = [("m", i) for i in random.sample(range(5000), 5000)]
    df = spark.createDataFrame(rows, "model string, t int")
    kept = latest_per_key(df, ["model"], [F.col("t").desc()], 1200)
    assert sorted(r["t"] for r in kept.collect()) == list(range(3800, 5000))


def test_stream_states_equal_batch_states(spark, folder):
    queries = catalog.queries()
    names = [f.strip().split(" ")[0] for f in STATE_SCHEMA.split(",")]
    batch = sorted(map(str, queries["alert_state"](spark, folder).select(*names).collect()))
    stream = sorted(map(str, queries["stateful_alert"](spark, folder).select(*names).collect()))
    assert batch == stream


def test_costly_rows_leave_the_one_row_group_of_their_file(spark, tmp_path):
    from tidemill.catalog import records

    rows = spark.range(200_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 97 AS user_id",
        "'click' AS event_type", "rand(1) AS value", "concat('{\"k\": ', id % 100, '}') AS props",
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    docs = records.documents(spark, str(tmp_path))
    sizes = [r[0] for r in docs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 4 and max(sizes) < 100_000


def test_fits_pass_over_written_rows_in_even_tasks(spark, monkeypatch):
    from tidemill.operators import training as T

    monkeypatch.setattr(T, "TASK_ROWS", 1000)
    rows = spark.range(0, 5000, 1, 1).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 3 = 0 AS INT) AS label")
    with T.training_table(rows) as table:
        sizes = [r[0] for r in table.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 5000 and len(sizes) == 5 and max(sizes) <= 1100
        assert table.inputFiles()
    assert T.fit(rows, ["a"], numTrees=3, balanced=True).stages[-1].getNumTrees == 3


def test_the_last_row_of_an_entity_alone_is_packed(spark):
    from tidemill.operators import store as S

    rows = spark.range(0, 4000, 1, 4).selectExpr("CAST(id % 3 AS STRING) AS user_id", "id AS n", "CAST(id AS STRING) AS text", "map('a', id) AS m")
    packed = S.pack_features(rows, "g", processing_time="2024-02-01", order=["n"], drop=("n",))
    assert packed.count() == 3
    state = S.upsert(spark.createDataFrame([], S.STORE_SCHEMA), packed)
    found = {r.entity_id: r.features for r in state.collect()}
    assert {k: v["text"] for k, v in found.items()} == {"0": '"3999"', "1": '"3997"', "2": '"3998"'}
    same = rows.unionByName(rows.withColumn("text", F.lit("other")))
    results = [
        sorted(map(str, S.pack_features(df, "g", processing_time="2024-02-01", order=["n"]).collect()))
        for df in (same.repartition(7), same.repartition(2, "text"))
    ]
    assert results[0] == results[1]


def test_entry_gives_a_plain_session_the_method_limit(spark):
    from tidemill.session import with_method_limit

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        assert with_method_limit(spark).conf.get(name) == "8000"
        spark.conf.set(name, "4000")
        assert with_method_limit(spark).conf.get(name) == "4000"
    finally:
        spark.conf.set(name, before)


def test_training_queries_extract_their_rows_once(spark, folder):
    result = catalog.queries()["fit_logistic"](spark, folder)
    assert result.inputFiles() and not [f for f in result.inputFiles() if "events.parquet" in f]


def noisy_rows(spark, n):
    return spark.range(0, n, 1, 2).selectExpr(
        "CAST(id % 7 AS DOUBLE) AS a", "CAST(id * 37 % 11 AS DOUBLE) AS b", "CAST(pmod(hash(id, 1), 5) AS DOUBLE) AS c",
        "CAST((id % 7 + id * 37 % 11 > 8) = (pmod(hash(id), 10) > 1) AS INT) AS label",
    )


def test_boosted_trees_are_fitted_to_summed_rows(spark, monkeypatch):
    """As many as there are bins and labels that occur together, and the model is that of the single rows."""
    from tidemill.operators import training as T

    sizes, plain = [], T.GBTClassifier.fit
    monkeypatch.setattr(T.GBTClassifier, "fit", lambda self, df, *args: sizes.append(df.count()) or plain(self, df, *args))
    rows = noisy_rows(spark, 6000)
    model = T.fit(rows, ["a", "b", "c"], "boosted_trees", maxIter=8, maxDepth=4)
    assert len(sizes) == 1 and sizes[0] <= 2 * 7 * 11 * 5
    single = T.as_doubles(rows, ["a", "b", "c", "label"])
    direct = T.build_pipeline(["a", "b", "c"], T.estimator("boosted_trees", maxIter=8, maxDepth=4)).fit(single)
    found, want = (
        {r[:3]: r.probabilities[1] for r in T.score(m, rows, ["a", "b", "c"], ["a", "b", "c"]).distinct().collect()} for m in (model, direct)
    )
    assert len(found) == 385 and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_bins_end_half_way_between_their_values(spark):
    from tidemill.operators import binned

    rows = spark.range(0, 5000, 1, 3).selectExpr("CAST(id * id AS DOUBLE) AS x", "CAST(id % 3 AS DOUBLE) AS y")
    values = binned.bin_values(rows, ["x", "y"], 32)
    assert len(values["x"]) == 32 and values["y"] == [0.0, 1.0, 2.0]
    numbered = rows.select("x", "y", binned.bin_number(F.col("x"), values["x"]).alias("i"), binned.bin_number(F.col("y"), values["y"]).alias("j"))
    for r in numbered.collect():
        assert r.j == r.y and r.i == min(range(32), key=lambda i: (abs(values["x"][i] - r.x), i))
    cells = binned.with_values(binned.cells(rows, {"x": values["x"]}, ["y"], F.lit(1.0)), {"x": values["x"]})
    sums = cells.groupBy("x").agg(F.sum("_weight").alias("n")).collect()
    assert sorted(r.x for r in sums) == values["x"] and sum(r.n for r in sums) == 5000 and max(r.n for r in sums) < 250


def test_a_forest_holds_those_of_fewer_trees_and_levels():
    import numpy as np

    from tidemill.operators import binned

    rng = np.random.default_rng(3)
    bins, rows, held = rng.integers(0, 9, (400, 5)), rng.integers(0, 6, (400, 2)).astype(float), rng.integers(0, 9, (90, 5))
    grown = [list(binned.grow(bins, rows, held, d, 2, np.random.default_rng(8))) for d in ([2, 6, 30], [6], [2])]
    assert [len(x) for x in grown] == [3, 1, 1] and (grown[0][1] == grown[1][0]).all() and (grown[0][0] == grown[2][0]).all()
    assert len(set(grown[2][0])) <= 4 < len(set(grown[0][2]))
    score, own = rng.integers(0, 5, 90).astype(float), rng.integers(0, 4, (90, 2)).astype(float)
    pairs = [(a > b) + (a == b) / 2 for a, n in zip(score, own[:, 1]) for b, m in zip(score, own[:, 0]) for _ in range(int(n * m))]
    assert abs(binned.area(score, own) - np.mean(pairs)) < 1e-12


def test_a_search_grows_shared_forests_as_good_as_single_ones(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    from tidemill.operators import training as T

    rows, columns = noisy_rows(spark, 3000), ["a", "b", "c"]
    fits, plain = [], T.RandomForestClassifier.fit
    monkeypatch.setattr(T.RandomForestClassifier, "fit", lambda self, *args: fits.append(1) or plain(self, *args))
    found = T.tune(rows, columns, "random_forest", trials=4, folds=3)
    assert len(fits) == 1 and len(found.avgMetrics) == 4
    model = T.estimator("random_forest")
    grid = T.search_grid("random_forest", model, 4)
    assert found.bestModel.stages[-1].getNumTrees == max(zip(found.avgMetrics, [next(v for p, v in x.items() if p.name == "numTrees") for x in grid]))[1]
    evaluator = BinaryClassificationEvaluator(labelCol="label")
    single = CrossValidator(estimator=T.build_pipeline(columns, model), estimatorParamMaps=grid[:2], evaluator=evaluator, numFolds=3, seed=42)
    want = single.fit(T.as_doubles(rows, [*columns, "label"])).avgMetrics
    assert all(abs(a - b) < 0.02 for a, b in zip(found.avgMetrics, want)), (found.avgMetrics, want)


def test_tune_searches_the_published_points_and_folds(spark, folder, monkeypatch):
    from types import SimpleNamespace

    from tidemill.catalog import training as C

    asked = []

    def search(rows, columns, kind, **options):
        asked.append((kind, options["trials"], options["folds"]))
        return SimpleNamespace(avgMetrics=[0.7] * options["trials"])

    monkeypatch.setattr(C.T, "tune", search)
    found = catalog.queries()["tune"](spark, folder)
    assert asked == [("random_forest", 20, 5)] and sorted(r.trial for r in found.collect()) == list(range(20))
    assert "range(20)" in catalog.oracle_sql()["tune"]
