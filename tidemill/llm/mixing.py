"""Mixing sources to target weights.

Every document gets a hash-random key and each source is put in the order of
these keys. Keys are uniform, so equal ranges of keys are equal shares of a
source: a source of any size falls into ranges of a few thousand rows each.
Totals of the ranges, summed along the source, turn sums within a range into
sums over the whole source, and the source is cut where its budget is spent.
Budgets beyond the source's size repeat it in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, text_of
from tidemill.session import materialize, work_path

_KEY_BITS = 60


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("bigint")


def random_key(seed: str, name: str = "doc_id") -> Column:
    """A 60-bit key from the id alone, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(name).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("bigint")


def cycling_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights dealt in turn to sources in code point order, null last.

    ``sizes`` has one row per source, so that the window sees no documents.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    dealt = F.array(*(F.lit(w) for w in weights))
    return sizes.withColumn("weight", F.get(dealt, turn).cast("bigint"))


def targets_of(sizes: DataFrame, share: float, most: int) -> DataFrame:
    """Source targets: ``share`` of all words by weight, none above ``most`` epochs.

    What a full source cannot take goes to the others by weight until none is
    above its limit. Sources in the order of limit over weight fill up one by
    one, so the common level is found in one pass over the sources.
    """
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        sizes.withColumn("limit", F.col("source_size") * most)
        .withColumn("fill", F.col("limit").cast("double") / F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("weight_left"))
        .withColumn(
            "common",
            F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(all_rows)["level"],
        )
    )
    limit = F.col("limit").cast("double")
    return levels.select(
        "source",
        "source_size",
        F.coalesce(F.least(limit, F.col("common") * F.col("weight")), limit).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] | DataFrame = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    range_rows: int = 5_000,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document over all epochs;
    the document at which a budget ends gives only its first words. ``weights``
    are dealt in turn, or come as a table (source, weight). A null text has size
    0, a null source is a source, rows with the same id follow each other by
    size and text. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            word_count().alias("size"),
            random_key(seed).alias("key"),
            F.xxhash64(text_of()).alias("tie"),
        ),
        work_path(spark, "mix-sized"),
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("named"), F.col("weight").cast("bigint").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    else:
        weighted = cycling_weights(sizes, weights)
    targets = targets_of(weighted, share, most)
    plan = materialize(
        targets.withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "planned"),
        work_path(spark, "mix-plan"),
    )
    largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    ranges = max(1, -(-largest // range_rows))
    ranged = sized.withColumn("part", F.expr(f"key div {-(-(1 << _KEY_BITS) // ranges)}"))
    along = Window.partitionBy("source_in").orderBy("part_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(F.col("source").alias("source_in"), F.col("part").alias("part_in"))
        .agg(F.sum("size").alias("part_size"))
        .select("source_in", "part_in", F.coalesce(F.sum("part_size").over(along), F.lit(0)).alias("start"))
    )
    within = (
        Window.partitionBy("source", "part")
        .orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        ranged.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("source_in")) & (F.col("part") == F.col("part_in")))
        .join(plan, F.col("source").eqNullSafe(F.col("planned")))
        .withColumn("begin", F.col("start") + F.col("inner"))
    )
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begin")))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + cut).cast("bigint").alias("taken"),
        "tie",
    )
