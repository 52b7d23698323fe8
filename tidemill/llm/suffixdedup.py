"""Removal of repeated byte strings by bucket-pointer refinement.

A string of ``length`` bytes counts as repeated when it also starts earlier in
the corpus. Suffixes are told apart in ever smaller buckets:

* Identifiers. The identifier of the ``2 h`` bytes at a place is made of the
  identifiers of ``h`` bytes there and ``h`` bytes later, so each depth reuses
  the one before it.
* Initial buckets are those of ``gram`` bytes. Not every suffix is filed: every
  window of ``length`` bytes is represented by its anchor, the first of its
  grams with the smallest identifier. Equal windows have equal anchors at equal
  places, so a window whose anchor is alone in its bucket is unique and leaves.
* Refinement sorts each bucket by the identifiers at later offsets: of the
  first and the last window that an anchor represents, which together cover all
  bytes of that segment. A segment equal to an earlier one is repeated whole.
* What is left are first copies of segments whose bucket holds several. Their
  windows are sorted by their own identifiers and a digest, and every one but
  the first of equal windows is repeated.

Sorted ranges are cut through buckets and classes. A class or bucket that a cut
divides goes to the last step, which settles it, so no group has to fit into a
task. Identity always rests on 128 bits: two independent identifiers, or an
identifier and a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import text_of
from tidemill.session import discard, materialize, work_path

_LAST = (1 << 63) - 1
_PLACE = "owner bigint, version bigint, first int, last int"
_ANCHORS = f"bucket bigint, later bigint, {_PLACE}"
_DECIDED = f"{_PLACE}, covered boolean"
_WINDOWS = "high bigint, low bigint, owner bigint, version bigint, first int, covered boolean"
#: Bytes and windows that a task handles at once.
_CHUNK, _WINDOW_CHUNK = 1 << 18, 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Identifiers of single bytes.
_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifier of a string from those of its first and its last bytes."""
    found = left * _ODD
    found += right
    found ^= found >> np.uint64(32)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return found


class Identifiers:
    """Identifiers of all strings of some lengths within a byte array."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        self._doubled = {1: _BYTES[data]}

    def of(self, depth: int) -> np.ndarray:
        """One per start of a string of ``depth`` bytes."""
        half = 1
        while 2 * half <= depth:
            if 2 * half not in self._doubled:
                own = self._doubled[half]
                self._doubled[2 * half] = _join(own[:-half], own[half:]) if len(own) > half else own[:0]
            half *= 2
        own, offset = self._doubled[half], depth - half
        return own if not offset else _join(own[:-offset], own[offset:]) if len(own) > offset else own[:0]


def _first_smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest key of every run of ``width`` keys."""
    # The upper bits decide; the place breaks ties towards the first.
    low = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: -(width - span)], low[width - span :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: bytes, sizes: list[int], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end: bucket, later, text, first, last.

    ``first`` and ``last`` are the places of the run's first and last window in their text.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    known = Identifiers(np.frombuffer(data, np.uint8))
    grams, whole = known.of(gram), known.of(length)
    anchor = _first_smallest(grams, length - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[text]
    anchor = np.where(inside, anchor, -1)
    cut = np.flatnonzero(np.diff(anchor, prepend=-2))
    until = np.append(cut[1:], len(anchor)) - 1
    cut, until = cut[anchor[cut] >= 0], until[anchor[cut] >= 0]
    held = anchor[cut]
    later = _join(_join(whole[cut], whole[until]), (held - cut).astype(np.uint64) + (until - cut).astype(np.uint64) * _ODD)
    base = (ends - sizes)[text[cut]]
    return grams[held].view(np.int64), later.view(np.int64), text[cut], cut - base, until - base


def _pieces(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[tuple[list, bytes, list[int]]]:
    """Chunks of whole short texts, and parts of long ones that overlap by a window less one byte.

    Rows are (owner, version, place of the part in its text).
    """
    rows, parts, held = [], [], 0
    for batch in batches:
        for owner, version, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            body = text.encode("utf-8", "surrogatepass")
            if len(body) < length:
                continue
            for start in range(0, len(body) - length + 1, chunk):
                part = body[start : start + chunk + length - 1]
                if rows and held + len(part) > 2 * chunk:
                    yield rows, b"".join(parts), [len(p) for p in parts]
                    rows, parts, held = [], [], 0
                rows.append((owner, version, start))
                parts.append(part)
                held += len(part)
    if rows:
        yield rows, b"".join(parts), [len(p) for p in parts]


def _places(rows: list, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, version, start = (np.array(c, np.int64) for c in zip(*rows))
    return owner[text], version[text], start[text]


def _anchors(length: int, gram: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, sizes in _pieces(batches, length, chunk):
            bucket, later, text, first, last = segments(data, sizes, length, gram)
            owner, version, start = _places(rows, text)
            yield pa.record_batch(
                [
                    pa.array(bucket),
                    pa.array(later),
                    pa.array(owner),
                    pa.array(version),
                    pa.array((start + first).astype(np.int32)),
                    pa.array((start + last).astype(np.int32)),
                ],
                names=["bucket", "later", "owner", "version", "first", "last"],
            )

    return run


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: later members of a class are covered, first members of divided buckets go on.

    The first and the last bucket of a range may reach into its neighbours, so their
    first members go on, too.
    """
    pending = None  # the only class of the open bucket so far: its first member
    last = None  # bucket and class of the row before
    divided = True  # the open bucket has several classes, or may have had rows before this range
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.record_batch(batch.columns, names=batch.schema.names)
        bucket, later = (batch.column(i).to_numpy() for i in (0, 1))
        same_bucket = np.empty(len(bucket), bool)
        same_bucket[0] = last is not None and last[0] == bucket[0]
        same_bucket[1:] = bucket[1:] == bucket[:-1]
        same_class = same_bucket.copy()
        same_class[0] &= last is not None and last[1] == later[0]
        same_class[1:] &= later[1:] == later[:-1]
        last = (bucket[-1], later[-1])
        run = np.cumsum(~same_bucket)  # 0 is the bucket left open by the batch before
        classes = np.bincount(run, weights=~same_class, minlength=run[-1] + 1).astype(np.int64)
        classes[0] += pending is not None
        several = classes > 1
        several[0] |= divided and begun
        if not begun:  # the range's first bucket
            several[1] = True
        ask = ~same_class & several[run]
        out = []
        if pending is not None and several[0]:
            out.append((pending, False))
            pending = None
        if run[-1] > 0:
            pending = None
        divided = bool(several[run[-1]])
        if not divided and (fresh := np.flatnonzero(~same_class & (run == run[-1]))).size:
            pending = batch.slice(int(fresh[0]), 1)
        begun = True
        if same_class.any():
            out.append((batch.filter(pa.array(same_class)), True))
        if ask.any():
            out.append((batch.filter(pa.array(ask)), False))
        for rows, covered in out:
            yield _decided(rows, covered)
    if pending is not None:
        yield _decided(pending, False)


def _decided(rows: pa.RecordBatch, covered: bool) -> pa.RecordBatch:
    return pa.record_batch(
        [*rows.columns[2:], pa.array(np.full(rows.num_rows, covered))], names=["owner", "version", "first", "last", "covered"]
    )


def _windows(length: int):
    """Windows of the segments that go on; of equal ones within a chunk only the first asks."""

    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        high, low, owner, version, first = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((first, version, owner, low, high))
        high, low, owner, version, first = (c[order] for c in (high, low, owner, version, first))
        covered = np.zeros(len(high), bool)
        covered[1:] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        return pa.record_batch(
            [*map(pa.array, (high, low, owner, version, first.astype(np.int32), covered))],
            names=["high", "low", "owner", "version", "first", "covered"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for owner, version, text, asked in zip(*(batch.column(i) for i in range(4))):
                body = text.as_py().encode("utf-8", "surrogatepass")
                struct = asked.values
                runs = np.stack([struct.field(0).to_numpy(), struct.field(1).to_numpy()], axis=1)
                for start in range(0, len(runs), 4096):
                    spans = [(a, b) for a, b in runs[start : start + 4096].tolist()]
                    data = b"".join([body[a : b + length] for a, b in spans])
                    known = Identifiers(np.frombuffer(data, np.uint8)).of(length)
                    counts = np.array([b - a + 1 for a, b in spans])
                    begins = np.cumsum(counts + length - 1) - (counts + length - 1)
                    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    at = np.repeat(begins, counts) + within
                    digest = hashlib.blake2b
                    low = b"".join([digest(data[i : i + length], digest_size=8).digest() for i in at.tolist()])
                    first = np.repeat([a for a, _ in spans], counts) + within
                    n = len(at)
                    held.append(
                        (
                            known[at].view(np.int64),
                            np.frombuffer(low, "<i8"),
                            np.full(n, owner.as_py(), np.int64),
                            np.full(n, version.as_py(), np.int64),
                            first,
                        )
                    )
                    total += n
                    if total >= _WINDOW_CHUNK:
                        yield emit(held)
                        held, total = [], 0
        if held:
            yield emit(held)

    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that are covered, of rows sorted by identifier, digest and place."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low = (batch.column(i).to_numpy() for i in (0, 1))
        same = np.empty(len(high), bool)
        same[0] = last == (high[0], low[0])
        same[1:] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        last = (high[-1], low[-1])
        rows = batch.filter(pa.array(same | batch.column("covered").to_numpy(zero_copy_only=False)))
        yield pa.record_batch(
            [rows.column("owner"), rows.column("version"), rows.column("first"), rows.column("first")],
            names=["owner", "version", "first", "last"],
        )


def _versioned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, and each document once. Rows are named by id and, where ids repeat, also by text."""
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unique = repeated.isEmpty()
    version = F.lit(0).cast("bigint") if unique else F.xxhash64(text_of())
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("owner"), version.alias("version"), text_of().alias("text")
    )
    return rows, rows if unique else rows.dropDuplicates(["owner", "version"])


def repeated_strings(rows: DataFrame, length: int = 100, gram: int = 40, chunk: int = _CHUNK) -> DataFrame:
    """Runs of starts of repeated strings: owner, version, first, last.

    ``rows`` has owner, version and text; owner and version name and order the texts.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram must not be longer than the strings")
    spark = rows.sparkSession
    filed = work_path(spark, "suffix-anchors")
    anchors = materialize(rows.mapInArrow(_anchors(length, gram, chunk), _ANCHORS), filed)
    order = ["bucket", "later", "owner", "version", "first"]
    decided = materialize(
        anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_refine, _DECIDED),
        work_path(spark, "suffix-segments"),
    )
    discard(spark, filed)
    asked = (
        decided.filter(~F.col("covered"))
        .groupBy("owner", "version")
        .agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    )
    # A hash join reads the texts without sorting them, and does so at any size.
    texts = rows.join(asked.hint("shuffle_hash"), ["owner", "version"]).select("owner", "version", "text", "asked")
    keys = ["high", "low", "owner", "version", "first"]
    windows = texts.mapInArrow(_windows(length), _WINDOWS).repartition("high", "low").sortWithinPartitions(*keys)
    settled = materialize(windows.mapInArrow(_later_windows, _PLACE), work_path(spark, "suffix-windows"))
    return decided.filter("covered").drop("covered").unionByName(settled)


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                body = text.as_py().encode("utf-8", "surrogatepass")
                sizes.append(len(body))
                if not runs.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(body)
                    continue
                first, last = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
                depth = np.zeros(len(body) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, last + length, -1)
                gone = np.cumsum(depth)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
            yield pa.record_batch(
                [
                    batch.column("owner"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["owner", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 40, chunk: int = _CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_bytes.

    Texts are UTF-8 bytes, and null counts as empty. Every byte goes that a
    string of ``length`` bytes covers which also starts earlier: in a document
    with a smaller id, or further ahead in the same one. Strings never cross
    documents and are judged on the input. ``n_spans`` counts the removed runs.
    Documents without an id come last; documents that share an id follow each
    other by a hash of their texts, and rows that repeat id and text are one
    document given twice, which get equal rows. Texts shorter than ``length``
    stay whole. An empty table gives an empty result; other columns are ignored.
    """
    rows, once = _versioned(docs)
    runs = (
        repeated_strings(once, length, gram, chunk)
        .groupBy("owner", "version")
        .agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    )
    joined = rows.join(runs.hint("shuffle_hash"), ["owner", "version"], "left").select("owner", "text", "runs")
    kept = joined.mapInArrow(_keep(length), "owner bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary")
    return kept.select(
        F.when(F.col("owner") != _LAST, F.col("owner")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_bytes"
    )
