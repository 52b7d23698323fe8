"""Line deduplication that returns bitmaps.

Hashes of lines are cut into ranges and ordered by hash, document and position,
so one pass over a range meets the first document that holds a line before all
others. Because the cut runs through (hash, document, position), a line that a
third of all documents share is spread over many ranges. Only the first
document of a range's first hash may be preceded by one in an earlier range;
such rows are set aside with the hash at which each range ends, and the few of
them are settled at the end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import text_of
from tidemill.session import materialize, work_path

_LINES = "high bigint, low bigint, owner bigint, version bigint, position int"
_FOUND = _LINES + ", kind string"
_LAST = (1 << 63) - 1


def _lines(minimum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owners, versions, positions = [], [], [], []
            for owner, version, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for position, line in enumerate(text.split("\n")):
                    key = line.strip(" \t\n\v\f\r")
                    if len(key) >= minimum:
                        key = key.encode("utf-8", "surrogatepass").lower()
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        owners.append(owner)
                        versions.append(version)
                        positions.append(position)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(owners, pa.int64()),
                    pa.array(versions, pa.int64()),
                    pa.array(positions, pa.int32()),
                ],
                names=["high", "low", "owner", "version", "position"],
            )

    return run


def _later_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range whose line an earlier document holds, and its edges."""
    last = None  # hash and first owner of the run that is open
    first_run = True
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, owner = (batch.column(i).to_numpy() for i in range(3))
        fresh = np.empty(len(high), bool)
        fresh[0] = last is None or (high[0], low[0]) != last[:2]
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(high)), -1))
        holder = np.where(at >= 0, owner[at], last[2] if last else 0)
        later = owner != holder
        begun = np.cumsum(fresh) - (1 if last is None else 0)
        edge = (begun == 0) & ~later if first_run else np.zeros(len(high), bool)
        first_run = first_run and begun[-1] == 0
        last = (high[-1], low[-1], holder[-1])
        if (later | edge).any():
            picked = pa.array(later | edge)
            kinds = np.where(edge, "edge", "later")[later | edge]
            rows = batch.filter(picked)
            yield pa.record_batch([*rows.columns, pa.array(kinds, pa.string())], names=[*rows.schema.names, "kind"])
    if last is not None:
        yield pa.record_batch(
            [
                pa.array([last[0]], pa.int64()),
                pa.array([last[1]], pa.int64()),
                pa.array([last[2]], pa.int64()),
                pa.array([None], pa.int64()),
                pa.array([None], pa.int32()),
                pa.array(["end"]),
            ],
            names=["high", "low", "owner", "version", "position", "kind"],
        )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for positions in batch.column("positions"):
            gone = np.unique(positions.values.to_numpy())
            keep = np.ones(int(gone[-1]) // 8 * 8 + 8, np.uint8)
            keep[gone] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(len(gone))
        yield pa.record_batch(
            [batch.column("owner"), batch.column("version"), pa.array(maps, pa.binary()), pa.array(dropped, pa.int64())],
            names=["owner", "version", "keep_bitmap", "n_dropped"],
        )


def _versioned(docs: DataFrame) -> DataFrame:
    """Rows named by id and text, since an id may come twice; null ids come last."""
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("owner"),
        F.xxhash64(text_of()).alias("version"),
        text_of().alias("text"),
    )


def repeated_lines(docs: DataFrame, minimum: int = 10) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: owner, version, keep_bitmap, n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. A key of ``minimum`` code points or more stays in the smallest
    id that holds it, there as often as it occurs. Bit ``i`` of the inflated map
    says whether line ``i`` stays; lines after its end stay. Null or empty text
    is one empty line, too short to be dropped. A null id (``owner`` is then the
    largest number) comes after all others, rows that share an id count as one
    document, and so an exact repeat gets the same map. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    lines = materialize(_versioned(docs).mapInArrow(_lines(minimum), _LINES), work_path(spark, "lines"))
    order = ["high", "low", "owner", "version", "position"]
    found = materialize(
        lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_later_holders, _FOUND),
        work_path(spark, "line-runs"),
    )
    edges = found.filter(F.col("kind") != "later")
    first = edges.groupBy("high", "low").agg(F.min("owner").alias("first_owner"))
    settled = edges.filter(F.col("kind") == "edge").join(first, ["high", "low"]).filter("owner > first_owner")
    dropped = found.filter(F.col("kind") == "later").select("owner", "version", "position").unionByName(
        settled.select("owner", "version", "position")
    )
    return (
        dropped.groupBy("owner", "version")
        .agg(F.collect_list("position").alias("positions"))
        .mapInArrow(_bitmaps, "owner bigint, version bigint, keep_bitmap binary, n_dropped bigint")
    )


def _keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, texts = [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist()):
            lines = text.split("\n")
            totals.append(len(lines))
            if packed is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
                lines = [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]
            texts.append("\n".join(lines))
        yield pa.record_batch(
            [batch.column("owner"), pa.array(totals, pa.int64()), batch.column("n_dropped"), pa.array(texts, pa.string())],
            names=["owner", "n_lines", "n_dropped", "kept_text"],
        )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text."""
    # A hash join reads the texts without sorting them, and does so at any size.
    joined = _versioned(docs).join(bitmaps.hint("shuffle_hash"), ["owner", "version"], "left")
    kept = joined.select(
        "owner", "text", "keep_bitmap", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped")
    ).mapInArrow(_keep_lines, "owner bigint, n_lines bigint, n_dropped bigint, kept_text string")
    return kept.select(F.when(F.col("owner") != _LAST, F.col("owner")).alias("doc_id"), "n_lines", "n_dropped", "kept_text")
