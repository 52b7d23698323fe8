"""Ranked lexical search over impact vectors in buckets of like length.

A document is the vector of its terms' impacts, an item that of its terms'
weights, and the score is their inner product. Vectors are range-partitioned by
Euclidean length, the longest first, and a task cuts its range into buckets of
consecutive vectors. Against the k-th best score an item has so far,

* a bucket is passed over when item length times the bucket's largest length
  stays below it (Cauchy-Schwarz);
* within a bucket the item's heaviest coordinates are taken until the same bound
  on the others stays below it. Only documents that hold one of these can win,
  and for them the bound is their part of the product on these coordinates plus
  the rest's length times the length that the document has left;
* survivors are scored anew in integers over all coordinates.

A first search of every sixteenth vector gives each item a score that its k best
must reach; a second one goes over all the others. Both are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import materialize, work_path

#: Term occurrences of the items that are searched together. Workers hold their terms.
BLOCK_TERMS = 200_000
#: Documents and term occurrences of a bucket.
BUCKET_ROWS, BUCKET_TERMS = 4096, 1 << 20
_LAST = (1 << 63) - 1
#: Letters and digits of ASCII, A-Z lower-cased, and all bytes of other characters; the rest parts terms.
_TERM_BYTES = bytes(i if i >= 0x80 else ord(chr(i).lower()) if chr(i).isalnum() else 0x20 for i in range(256))

_ITEMS = "terms array<binary>, counts array<int>"
_INDEX = "doc_id bigint, n bigint, terms binary, counts binary"
_VECTORS = "length double, doc_id bigint, turn int, terms binary, impacts binary"
_FOUND = "query bigint, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


@dataclass
class _Block:
    """Items in rows; a row's terms are numbers into ``vocabulary``."""

    queries: np.ndarray
    rows: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]


@dataclass
class _Weighted:
    """Items with weighted terms, the heaviest first."""

    queries: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    #: Length of what is left of an item after its first j terms.
    rest: list[np.ndarray]
    size: int


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = [], []
        for text in batch.column("text").to_pylist():
            held: dict[bytes, int] = {}
            for term in terms_of(text):
                held[term] = held.get(term, 0) + 1
            terms.append(list(held))
            counts.append(list(held.values()))
        yield pa.record_batch(
            [batch.column("item_id"), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))],
            names=["item_id", "terms", "counts"],
        )


def _block(rows: list) -> _Block:
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms], np.int64) for r in rows]
    return _Block(np.array([r.query for r in rows], np.int64), numbers, [np.array(r.counts, np.int64) for r in rows], vocabulary)


def _index(block: Broadcast):
    """Per document: all its terms' number, and the block's terms among them with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.value.vocabulary.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                own = terms_of(text)
                held = [t for t in map(number, own) if t is not None]
                found, n = np.unique(np.array(held, np.uint32), return_counts=True)
                sizes.append(len(own))
                terms.append(found.tobytes())
                counts.append(n.astype(np.uint32).tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary arrays, and how many each row has."""
    parts = column.to_pylist()
    flat = np.frombuffer(b"".join(parts), kind)
    return flat, np.array([len(p) for p in parts], np.int64) // flat.itemsize


def _document_counts(size: int):
    """Documents of a task that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch.column("terms"), "<u4")[0], minlength=size)
        terms = np.flatnonzero(held)
        yield pa.record_batch([pa.array(terms.astype(np.int32)), pa.array(held[terms])], names=["term", "n"])

    return run


def _vectors(documents: int, occurrences: int):
    """Impacts and lengths of documents that hold any of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            tf, sizes = _flat(batch.column("counts"), "<u4")
            # Python's integers, since 75 * n * N may pass 64 bits.
            m = np.array([25 + 75 * x * documents // occurrences for x in n.tolist()], np.int64)
            tf = tf.astype(np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            ends = np.cumsum(sizes)
            # Sums may wrap around; their differences are exact as long as a row's own sum fits.
            total = np.concatenate([[0], np.cumsum(impacts * impacts)])
            squares = total[ends] - total[ends - sizes]
            packed = [impacts[b - s : b].astype("<u4").tobytes() for b, s in zip(ends, sizes)]
            yield pa.record_batch(
                # Lengths are bounds and are drawn up past rounding.
                [
                    pa.array(np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)),
                    batch.column("doc_id"),
                    batch.column("turn"),
                    batch.column("terms"),
                    pa.array(packed, pa.binary()),
                ],
                names=["length", "doc_id", "turn", "terms", "impacts"],
            )

    return run


class _Best:
    """The k best documents of each item so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k = k
        self.floors = floors.copy()
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in floors]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.found[item][0], ids]), np.concatenate([self.found[item][1], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[item] = ids[order], scores[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], scores[order[-1]])


def _search_bucket(
    items: _Weighted, best: _Best, dense: np.ndarray, length: np.ndarray, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray
) -> None:
    most = float(length.max())
    whole = np.array([r[0] for r in items.rest])
    slack = 1 - 1e-9
    reached = np.flatnonzero((whole * most >= best.floors * slack) & (whole > 0))
    if not len(reached):
        return
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(terms, kind="stable")
    by_term = terms[order]
    holder = np.repeat(np.arange(len(ids)), sizes)[order]
    impact = impacts[order].astype(np.float64)
    squares = length * length
    for item in reached.tolist():
        own, weights, rest = items.terms[item], items.weights[item], items.rest[item]
        floor = float(best.floors[item])
        focus = max(1, int(np.searchsorted(-rest * most, -floor * slack, side="right"))) if floor > 0 else len(own)
        focus = min(focus, len(own))
        starts = np.searchsorted(by_term, own[:focus], side="left")
        ends = np.searchsorted(by_term, own[:focus], side="right")
        spans = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist())]
        who = np.concatenate([holder[s] for s in spans])
        if not len(who):
            continue
        part = np.concatenate([impact[s] for s in spans])
        weighed = part * np.repeat(weights[:focus].astype(np.float64), ends - starts)
        product = np.bincount(who, weights=weighed, minlength=len(ids))
        left = np.sqrt(np.maximum(squares - np.bincount(who, weights=part * part, minlength=len(ids)), 0))
        if len(ids) > best.k:  # what is known of a product is a lower bound of it
            floor = max(floor, float(np.partition(product, -best.k)[-best.k]))
        going = np.flatnonzero((product > 0) & (product + rest[focus] * left * (1 + 1e-9) >= floor * slack))
        if not len(going):
            continue
        dense[own] = weights
        count = sizes[going]
        at = np.repeat(begins[going] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        scores = np.add.reduceat(dense[terms[at]] * impacts[at].astype(np.int64), np.cumsum(count) - count)
        dense[own] = 0
        good = (scores > 0) & (scores >= best.floors[item])
        best.add(item, ids[going][good], scores[good])


def _search(items: Broadcast, floors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, dense = _Best(floors, k), np.zeros(items.value.size, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
            terms, sizes = _flat(batch.column("terms"), "<u4")
            impacts, _ = _flat(batch.column("impacts"), "<u4")
            ends = np.cumsum(sizes)
            row = 0
            while row < len(ids):
                begin = int(ends[row] - sizes[row])
                until = min(row + BUCKET_ROWS, max(row + 1, int(np.searchsorted(ends, begin + BUCKET_TERMS, side="right"))))
                cut = slice(begin, int(ends[until - 1]))
                _search_bucket(items.value, best, dense, length[row:until], ids[row:until], sizes[row:until], terms[cut], impacts[cut])
                row = until
        counts = [len(x) for x, _ in best.found]
        yield pa.record_batch(
            [
                pa.array(np.repeat(items.value.queries, counts)),
                pa.array(np.concatenate([x for x, _ in best.found])),
                pa.array(np.concatenate([x for _, x in best.found])),
            ],
            names=["query", "doc_id", "score"],
        )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _weighted(block: _Block, held: dict[int, int], documents: int) -> _Weighted:
    weight = np.zeros(len(block.vocabulary), np.int64)
    for term in range(len(weight)):
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(term, 0) + 1)))
    terms, weights, rest = [], [], []
    for row, counts in zip(block.rows, block.counts):
        own = weight[row] * counts
        order = np.argsort(-own, kind="stable")
        terms.append(row[order])
        weights.append(own[order])
        tail = np.cumsum((own[order].astype(np.float64) ** 2)[::-1])[::-1]
        rest.append(np.sqrt(np.append(tail, 0.0)) * (1 + 1e-12))
    return _Weighted(block.queries, terms, weights, rest, len(weight))


def _search_block(spark: SparkSession, docs: DataFrame, block: _Block, k: int) -> DataFrame:
    """The k best documents of each item of a block: query, doc_id, score, rank."""
    held_block = spark.sparkContext.broadcast(block)
    index = materialize(docs.mapInArrow(_index(held_block), _INDEX), work_path(spark, "lexical-index"))
    totals = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("occurrences")).first()
    if not totals.occurrences:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    counted = index.mapInArrow(_document_counts(len(block.vocabulary)), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    held = {row.term: row.n for row in counted.collect()}  # terms of the block
    items = spark.sparkContext.broadcast(_weighted(block, held, totals.documents))
    turned = index.filter(F.octet_length("terms") > 0).withColumn("turn", F.expr("cast(pmod(xxhash64(doc_id, terms), 16) as int)"))
    vectors = turned.mapInArrow(_vectors(totals.documents, totals.occurrences), _VECTORS)
    order = [F.desc("length"), F.xxhash64("doc_id", "terms")]
    ordered = materialize(
        vectors.repartitionByRange(*order).sortWithinPartitions(*order), work_path(spark, "lexical-vectors")
    )
    floors = np.zeros(len(block.queries), np.int64)
    first = materialize(
        _best(ordered.filter("turn = 0").mapInArrow(_search(items, floors, k), _FOUND), k), work_path(spark, "lexical-first")
    )
    place = {query: i for i, query in enumerate(block.queries.tolist())}
    for row in first.filter(F.col("rank") == k).collect():  # one row per item of the block
        floors[place[row.query]] = row.score
    others = ordered.filter("turn <> 0").mapInArrow(_search(items, floors, k), _FOUND)
    found = materialize(_best(first.drop("rank").unionByName(others), k), work_path(spark, "lexical-found"))
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text. Terms are runs of
    ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null text has
    none. A term of weight w that occurs tf times adds, for each time it occurs
    in the item, w * (10^9 * tf div (1000 * tf + 8 * m)) to a document's score,
    where w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N div L):
    n terms in the document, N documents with terms, L terms in all, df documents
    with the term. Only scores above 0 count, and ties go to the smaller doc_id.
    Every row of ``docs`` is a document and every row of ``items`` an item, repeated
    ids included; documents without an id come last among ties. An item without
    terms, or an empty table, gives no rows; other columns are ignored. Items are
    searched in blocks of about ``BLOCK_TERMS`` term occurrences, the documents
    once per block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    listed = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {items.schema['item_id'].dataType.simpleString()}, {_ITEMS}")
    numbered = materialize(listed.withColumn("query", F.monotonically_increasing_id()), work_path(spark, "lexical-items"))
    size = numbered.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_TERMS))
    found = None
    for number in range(blocks):
        rows = numbered.filter(F.expr(f"pmod(xxhash64(query), {blocks}) = {number}")).filter(F.size("terms") > 0).drop("item_id").collect()
        if rows:
            part = _search_block(spark, texts, _block(rows), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"{_FOUND}, rank int")
    return found.join(numbered.select("query", "item_id"), "query").select(
        "item_id", "rank", F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "score"
    )
