"""Exact top-k search by distributed histogram selection.

Vectors travel in blocks, and every pair of a query block and a candidate block
is one row. Each round scores everything and adds up, per query, a histogram of
the scores inside the interval that still holds the k-th value; the bucket in
which it lies is the next interval. When intervals are one score wide, a last
pass keeps what scores more, and of the ties each block's smallest ids, of which
the smallest of all blocks fill the remaining places. Scores are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import materialize, work_path

_BLOCK = "width int, ids binary, vectors binary, most double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows with an id and only finite components."""
    v = F.col("vector")
    return (
        vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull())
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    )


def _pack(scale: float, rows: int):
    """Blocks of at most ``rows`` vectors of one width, quantized."""

    def emit(width, ids, values):
        matrix = np.floor(scale * np.array(values, np.float64).reshape(len(ids), width))
        most = float(np.abs(matrix).max()) if matrix.size else 0.0
        if most >= 2.0**62:
            raise OverflowError("a quantized component does not fit into 64 bits")
        kind = np.int16 if most < 2**15 else np.int64
        return pa.record_batch(
            [
                pa.array([width], pa.int32()),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([matrix.astype(kind).tobytes()], pa.binary()),
                pa.array([most], pa.float64()),
            ],
            names=["width", "ids", "vectors", "most"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            column = batch.column("vector")
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                width = int(offsets[i + 1] - offsets[i])
                ids, values = held.setdefault(width, ([], []))
                ids.append(vec_id)
                values.append(flat[offsets[i] : offsets[i + 1]])
                if len(ids) == rows:
                    yield emit(width, ids, values)
                    held[width] = ([], [])
        for width, (ids, values) in held.items():
            if ids:
                yield emit(width, ids, values)

    return run


def _blocks(vectors: DataFrame, scale: float, rows: int, name: str) -> DataFrame:
    """Blocks, written once and numbered from 0 within their width."""
    spark = vectors.sparkSession
    packed = materialize(vectors.mapInArrow(_pack(scale, rows), _BLOCK), work_path(spark, f"topk-{name}"))
    # A row per block, so the window is small: 1 / rows of the input.
    keyed = packed.select("width", F.xxhash64("ids", "vectors").alias("mark")).distinct()
    numbered = keyed.withColumn("block", F.row_number().over(Window.partitionBy("width").orderBy("mark")) - 1)
    marked = packed.withColumn("mark", F.xxhash64("ids", "vectors")).join(numbered, ["width", "mark"])
    return materialize(marked.drop("mark"), work_path(spark, f"topk-{name}-numbered"))


def _matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int16 if row[f"{side}_most"] < 2**15 else np.int64
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    return ids, np.frombuffer(row[f"{side}_vectors"], kind).reshape(len(ids), row["width"])


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the exact integer inner products."""
    query_ids, queries = _matrix(row, "query")
    ids, vectors = _matrix(row, "candidate")
    bound = row["query_most"] * row["candidate_most"] * max(1, row["width"])
    if bound < 2.0**53:  # sums of products are exact in double
        found = (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    else:
        exact = queries.astype(object) @ vectors.astype(object).T
        if np.abs(exact).max() >= 2**63:
            raise OverflowError("an inner product does not fit into 64 bits")
        found = exact.astype(np.int64)
    return query_ids, ids, found


def _histograms(bins: int):
    """Per query row: how many scores fall into each bucket of its interval, and above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, ids, scores = _scores(row)
                low = np.array(row["low"], np.int64)
                step = np.array(row["step"], np.int64)
                rows, buckets, counts = [], [], []
                for i in range(len(query_ids)):
                    if not step[i]:
                        continue
                    own = scores[i][ids != query_ids[i]]
                    at = np.minimum((own[own >= low[i]] - low[i]) // step[i], bins)
                    held = np.bincount(at, minlength=1)
                    full = np.flatnonzero(held)
                    rows.append(np.full(len(full), i, np.int32))
                    buckets.append(full.astype(np.int32))
                    counts.append(held[full])
                if rows:
                    n = sum(map(len, rows))
                    yield pa.record_batch(
                        [
                            pa.array([row["width"]] * n, pa.int32()),
                            pa.array([row["query_block"]] * n, pa.int32()),
                            pa.array(np.concatenate(rows)),
                            pa.array(np.concatenate(buckets)),
                            pa.array(np.concatenate(counts).astype(np.int64)),
                        ],
                        names=["width", "query_block", "query_row", "bucket", "n"],
                    )

    return run


def _winners(k: int):
    """All scores above each query's k-th value, and its ties with the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, ids, scores = _scores(row)
                out = [[], [], [], []]
                for i, low in enumerate(row["low"]):
                    other = ids != query_ids[i]
                    above = np.flatnonzero(other & (scores[i] > low))
                    ties = np.flatnonzero(other & (scores[i] == low))
                    ties = ties[np.argsort(ids[ties], kind="stable")[:k]]
                    found = np.concatenate([above, ties])
                    for column, values in zip(out, (np.full(len(found), i), np.full(len(found), query_ids[i]), ids[found], scores[i][found])):
                        column.append(values)
                row_, query_id, vec_id, score = (np.concatenate(c).astype(np.int64) for c in out)
                yield pa.record_batch(
                    [
                        pa.array([row["width"]] * len(row_), pa.int32()),
                        pa.array([row["query_block"]] * len(row_), pa.int32()),
                        pa.array(row_.astype(np.int32)),
                        pa.array(query_id),
                        pa.array(vec_id),
                        pa.array(score),
                    ],
                    names=["width", "query_block", "query_row", "query_id", "vec_id", "score"],
                )

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_rows: int = 1024,
    candidate_rows: int = 4096,
    bins: int = 1024,
) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x); the score is the inner product of
    such integers. Rows with a query's own id are no candidates for it, vectors
    of different widths never meet, and ties go to the smaller vec_id. Vectors
    that are null or hold null or non-finite components, and rows without an id,
    take no part. Repeated candidate rows count as often as they occur; a
    repeated query row gives its results again. A query without candidates gives
    no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    candidate = _blocks(usable(vectors, id_column, vector_column), scale, candidate_rows, "candidates")
    query = _blocks(usable(queries, id_column, vector_column), scale, query_rows, "queries")
    sizes = query.groupBy("width").agg(F.count("*").cast("int").alias("query_blocks"), F.max("most").alias("query_top"))
    others = candidate.groupBy("width").agg(F.count("*").cast("int").alias("candidate_blocks"), F.max("most").alias("candidate_top"))
    shape = sizes.join(others, "width")
    named = lambda df, side: df.select(
        "width",
        F.col("block").alias(f"{side}_block"),
        F.col("ids").alias(f"{side}_ids"),
        F.col("vectors").alias(f"{side}_vectors"),
        F.col("most").alias(f"{side}_most"),
    )
    candidates, queried = named(candidate, "candidate"), named(query, "query")
    # Both sides repeat their blocks for the other's, so a pair of blocks is a key.
    spread = candidates.join(shape.select("width", "query_blocks"), "width").withColumn(
        "query_block", F.explode(F.expr("sequence(0, query_blocks - 1)"))
    ).drop("query_blocks")
    reach = queried.join(shape, "width").withColumn("reach", F.col("query_top") * F.col("candidate_top") * F.greatest("width", F.lit(1)))
    n_rows = F.expr("cast(octet_length(query_ids) / 8 as int)")
    state = reach.select(
        "width",
        "query_block",
        F.expr("-cast(ceil(reach) as bigint)").alias("bottom"),
        F.expr(f"cast(ceil((2 * ceil(reach) + 1) / {bins}) as bigint)").alias("width_step"),
        n_rows.alias("n_rows"),
    )
    state = state.select(
        "width",
        "query_block",
        F.expr("array_repeat(bottom, n_rows)").alias("low"),
        F.expr("array_repeat(width_step, n_rows)").alias("step"),
    )
    state = materialize(state, work_path(spark, "topk-state"))

    def paired(current: DataFrame) -> DataFrame:
        asked = queried.join(current.select("width", "query_block", "low", "step"), ["width", "query_block"])
        asked = asked.join(shape.select("width", "candidate_blocks"), "width").withColumn(
            "candidate_block", F.explode(F.expr("sequence(0, candidate_blocks - 1)"))
        ).drop("candidate_blocks")
        return spread.join(asked, ["width", "query_block", "candidate_block"])

    while not state.filter(F.exists("step", lambda s: s > 0)).isEmpty():
        counted = paired(state).mapInArrow(
            _histograms(bins), "width int, query_block int, query_row int, bucket int, n bigint"
        )
        totals = counted.groupBy("width", "query_block", "query_row", "bucket").agg(F.sum("n").alias("n"))
        per_query = state.select("width", "query_block", F.posexplode(F.arrays_zip("low", "step")).alias("query_row", "s")).select(
            "width", "query_block", "query_row", "s.*"
        )
        # The lowest bucket at which the counts from above reach k holds the k-th value.
        down = Window.partitionBy("width", "query_block", "query_row").orderBy(F.desc("bucket"))
        reached = (
            totals.withColumn("upto", F.sum("n").over(down))
            .filter(F.col("upto") >= k)
            .groupBy("width", "query_block", "query_row")
            .agg(F.max("bucket").alias("bucket"))
        )
        refined = (
            per_query.join(reached, ["width", "query_block", "query_row"], "left")
            # Without such a bucket there are fewer than k candidates, and all win.
            .withColumn("next_low", F.coalesce(F.col("low") + F.col("bucket") * F.col("step"), F.col("low")))
            .withColumn(
                "next_step",
                F.when(F.col("bucket").isNotNull() & (F.col("step") > 1), F.expr(f"cast(ceil(step / {bins}) as bigint)"))
                .otherwise(F.lit(0)),
            )
        )
        gathered = refined.groupBy("width", "query_block").agg(
            F.sort_array(F.collect_list(F.struct("query_row", "next_low", "next_step"))).alias("s")
        )
        state = materialize(
            gathered.select(
                "width",
                "query_block",
                F.col("s.next_low").alias("low"),
                F.col("s.next_step").cast("array<bigint>").alias("step"),
            ),
            work_path(spark, "topk-state"),
        )
    won = paired(state).mapInArrow(
        _winners(k), "width int, query_block int, query_row int, query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("width", "query_block", "query_row").orderBy(F.desc("score"), "vec_id")
    return won.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
