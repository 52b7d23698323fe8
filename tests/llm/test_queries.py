"""Queries with a SQL twin against DuckDB; the others against facts that must hold."""

import pytest
from harness import connect, difference
from pyspark.sql import functions as F

from tidemill.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, folder, name):
    assert difference(QUERIES[name](spark, folder), duck, ORACLES[name]) is None


def test_language_accuracy_on_held_out_documents(spark, folder):
    found = QUERIES["op7_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    row = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] > 0.98


def test_language_model_beats_word_counts_on_held_out_documents(spark, folder):
    row = QUERIES["op1_lm_score"](spark, folder).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_quality_separates_held_out_labels(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op9_quality"](spark, folder).filter("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.9
