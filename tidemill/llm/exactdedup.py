"""Exact deduplication with an extendible-hash index on shared files.

A text is filed under its 64-bit key. The directory has ``2 ** depth`` slots,
one for each leading bit pattern, and doubles until no bucket holds more than
``capacity`` distinct keys; neighbouring slots share a bucket as long as their
common shorter prefix is not overfull. Copies have one key, so a large group of
copies never makes the directory grow. Index files are cut into ranges of
(bucket, key, digest, length, document), each of which has an owner task. An
owner walks its range in order and chains what collides on a key by digest and
length; the first and the last chain of a range may go on in its neighbours, and
these few are settled at the end. So a large group of copies has many owners.
Texts are then compared byte by byte with the text at the head of their chain.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import text_of
from tidemill.session import materialize, work_path

_CHAIN = ["key", "digest", "n_bytes"]
#: Copies of one chain that are compared with its head together.
SHARE_ROWS = 1000


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def entries_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What the index files about each document; the text itself stays behind."""
    text = text_of(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text).alias("key"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )


def directory_of(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Slots with their buckets, and the depth at which no bucket is overfull.

    A bucket is named by its first slot. The loop only sees a count per slot.
    """
    keys = entries.select("key").distinct()
    n_keys = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, n_keys) / capacity)))
    while True:
        slots = keys.groupBy(_prefix(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
        if depth >= 63 or slots.filter(F.col("n") > capacity).isEmpty():
            break
        depth += 1
    levels = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    ).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - level)"))
    fits = (
        levels.groupBy("level", "prefix")
        .agg(F.sum("n").alias("held"))
        .filter(F.col("held") <= capacity)
    )
    directory = (
        levels.join(fits, ["level", "prefix"])
        .groupBy("slot")
        .agg(F.min("level").alias("local_depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - local_depth), {depth} - local_depth)"))
    )
    return directory, depth


def build_index(docs: DataFrame, capacity: int = 20_000, **columns: str) -> DataFrame:
    """Write the index files and return them: bucket, key, digest, n_bytes, doc_id, owner."""
    spark = docs.sparkSession
    entries = materialize(entries_of(docs, **columns), work_path(spark, "exact-entries"))
    directory, depth = directory_of(entries, capacity)
    order = ["bucket", *_CHAIN, "doc_id"]
    filed = (
        entries.withColumn("slot", _prefix(F.col("key"), depth))
        .join(directory.select("slot", "bucket"), "slot", "left")
        .select(F.coalesce("bucket", "slot").alias("bucket"), *_CHAIN, "doc_id")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("owner", F.spark_partition_id())
    )
    return materialize(filed, work_path(spark, "exact-index"))


def chain_entries(index: DataFrame) -> DataFrame:
    """The index with each entry's chain: head_id, chain_size.

    An owner's range is one window. Its chains are numbered where key, digest or
    length change; only the first and the last of them are looked at again.
    """
    along = Window.partitionBy("owner").orderBy("bucket", *_CHAIN, "doc_id")
    same = reduce(lambda a, b: a & b, [F.lag(c).over(along).eqNullSafe(F.col(c)) for c in _CHAIN])
    opens = (~same | (F.row_number().over(along) == 1)).cast("bigint")
    walked = index.withColumn("_opens", opens).withColumn(
        "link", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    chain = Window.partitionBy("owner", "link")
    chained = walked.withColumns(
        {
            "head_id": F.max("doc_id").over(chain),
            "chain_size": F.count(F.lit(1)).over(chain),
            "_last": F.max("link").over(Window.partitionBy("owner")),
        }
    )
    edge = (F.col("link") == 1) | (F.col("link") == F.col("_last"))
    chained = materialize(
        chained.withColumn("edge", edge).drop("_opens", "_last"), work_path(index.sparkSession, "exact-chains")
    )
    # Two rows per owner.
    edges = chained.filter("edge").groupBy("owner", "link", *_CHAIN).agg(
        F.max("head_id").alias("head_id"), F.max("chain_size").alias("chain_size")
    )
    whole = edges.groupBy(*_CHAIN).agg(F.max("head_id").alias("_head"), F.sum("chain_size").alias("_size"))
    settled = edges.join(whole, _CHAIN).select("owner", "link", "_head", "_size")
    joined = chained.join(settled, ["owner", "link"], "left")
    return joined.select(
        *_CHAIN,
        "doc_id",
        F.when(F.col("edge"), F.col("_head")).otherwise(F.col("head_id")).alias("head_id"),
        F.when(F.col("edge"), F.col("_size")).otherwise(F.col("chain_size")).alias("chain_size"),
    )


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 20_000
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, key.

    The row with the largest id of a group of equal texts stays. Null texts
    count as empty. A null id counts as smaller than any other; a group with
    nulls only keeps them all. Rows that repeat id and text are one document
    given twice and share their fate. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(docs, capacity, id_column=id_column, text_column=text_column)
    entries = materialize(chain_entries(index), work_path(spark, "exact-chained"))
    copied = entries.filter("chain_size > 1")
    own = text_of(text_column)
    # Only texts whose key, digest and length occur twice are read again. Entries
    # are looked up by document, so that no group of copies meets in one task.
    texts = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(own).alias("key"),
        F.unhex(F.sha2(own.cast("binary"), 256)).alias("digest"),
        F.octet_length(own).cast("bigint").alias("n_bytes"),
        own.alias("body"),
    )
    # All entries of a chain carry the same facts, so a null id may share the
    # number that stands for it.
    place = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).alias("place")
    names = ["place", *_CHAIN]
    listed = copied.select(place, *_CHAIN, "head_id", "chain_size").dropDuplicates(names)
    # A hash join reads the texts without sorting them, and does so at any size.
    found = texts.withColumn("place", place).join(listed.hint("shuffle_hash"), names).drop("place")
    copies = materialize(
        found.withColumns(
            {
                "shares": F.ceil(F.col("chain_size") / SHARE_ROWS).cast("int"),
                "is_head": F.col("doc_id").eqNullSafe(F.col("head_id")),
            }
        ).withColumn("share", F.expr("cast(pmod(xxhash64(doc_id, body), shares) as int)")),
        work_path(spark, "exact-copies"),
    )
    # The head of a large chain goes to each share of its copies.
    heads = (
        copies.filter("is_head")
        .select(*_CHAIN, F.col("body").alias("head_body"), "shares")
        .dropDuplicates(_CHAIN)
        .withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
        .drop("shares")
    )
    compared = copies.join(heads, [*_CHAIN, "share"]).select(
        "doc_id", *_CHAIN, "head_id", "chain_size", F.when(F.col("body") != F.col("head_body"), F.col("body")).alias("other")
    )
    compared = materialize(compared, work_path(spark, "exact-compared"))
    alone = entries.filter("chain_size = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "digest", "key"
    )
    with_head = compared.filter(F.col("other").isNull())
    others = compared.filter(F.col("other").isNotNull())
    size = F.col("chain_size")
    settled = alone
    if not others.isEmpty():
        # Texts that differ from the head in spite of an equal digest are groups of their own.
        apart = others.groupBy(*_CHAIN, "other").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        with_head = with_head.join(apart.groupBy(*_CHAIN).agg(F.sum("group_size").alias("strays")), _CHAIN, "left")
        size = size - F.coalesce("strays", F.lit(0))
        strayed = others.join(apart, [*_CHAIN, "other"]).select("doc_id", "keep_id", "group_size", "digest", "key")
        settled = alone.unionByName(strayed)
    headed = with_head.select("doc_id", F.col("head_id").alias("keep_id"), size.alias("group_size"), "digest", "key")
    result = settled.unionByName(headed)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
