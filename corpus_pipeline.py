"""A packed training corpus from raw documents, in stages that write and read Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, packing
from tidemill.llm.common import text_of
from tidemill.llm.exactdedup import exact_duplicates
from tidemill.llm.mixing import mix_sources
from tidemill.llm.neardup import near_duplicates
from tidemill.session import table, work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_key(text_key: Column) -> Column:
    """Names a row by its id and text; null ids count as one id."""
    return F.xxhash64(F.col("doc_id"), text_key)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, _row_key(F.xxhash64(text_of())).alias("row_key"))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without any letter go.

    The model learns from every document whose ``lang`` is known.
    """
    model = langid.learn(docs.select("text", F.col("lang").alias("label")))
    judged = langid.identify(docs.select(*COLUMNS), model)
    return judged.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id goes on, once."""
    judged = exact_duplicates(docs)
    gone = judged.filter(~F.col("kept")).select(_row_key(F.col("key")).alias("row_key"))
    left = _keyed(docs).join(gone.hint("shuffle_hash"), "row_key", "left_anti")
    return left.dropDuplicates(["row_key", "doc_id"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates, the document with the smallest id goes on."""
    judged = near_duplicates(docs, words=5, percent=80)
    gone = judged.filter(~F.col("kept")).select(_row_key(F.col("text_key")).alias("row_key"))
    return _keyed(docs).join(gone.hint("shuffle_hash"), "row_key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that a budget cuts stays whole.

    A document without words has nothing to take and goes.
    """
    mixed = mix_sources(docs).filter("taken > 0")
    turns = F.expr("explode(sequence(1, cast(ceil(taken / size) as int)))")
    copies = mixed.select(_row_key(F.col("tie")).alias("row_key"), turns.alias("epoch"))
    return _keyed(docs).join(copies.hint("shuffle_hash"), "row_key").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 ids."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return digested.join(packing.place_pieces(pieces), ["row", "piece"]).drop("row")


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]
#: Learnt models and drawn trees have no SQL; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
