"""Centroid clustering with a vantage-point tree over the centroids.

Every round the driver builds a tree over the k current centroids and broadcasts
it; k and the width bound its size. A task searches the tree for each of its
vectors, best bound first: it takes the open node with the smallest lower bound
on the distance, compares the vector with the node's centroids in exact
integers, and stops when no open node can hold a centroid as near as the best
one. Nodes whose bound equals the best distance are still visited, since an
equally near centroid of a smaller number wins. The searches of a block of
vectors advance together, one node of each at a time. Tasks return sums per
cluster and component, which Spark adds up; only k sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize, work_path

#: A tree larger than this is refused, since every worker holds one.
MAX_TREE_BYTES = 256 << 20
_FAR = np.iinfo(np.int64).max
#: Differences of components below it fit into 64 bits.
_WIDEST = 1 << 61
_SUMS = "cluster int, component int, total bigint, n bigint"


@dataclass
class _Node:
    """Centroids of a leaf, or the vantage point (one centroid) of an inner node."""

    numbers: np.ndarray
    #: Child node, smallest and largest distance of its centroids from the vantage point.
    children: tuple[tuple[int, float, float], ...] = ()


@dataclass
class Tree:
    """A vantage-point tree; node 0 is the root."""

    centroids: np.ndarray
    nodes: list[_Node]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as 64-bit integers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    width = max(1, vectors.shape[1])
    if 4 * most * most * width >= 2**63:
        raise OverflowError("a squared distance does not fit into 64 bits")
    if 4 * most * most * width < 2**53:  # every term and sum is exact in double
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        found = (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (v @ c.T)
        return found.astype(np.int64)
    found = np.empty((len(vectors), len(centroids)), np.int64)
    for i, centroid in enumerate(centroids):
        apart = vectors.astype(np.int64) - centroid
        found[:, i] = np.einsum("ij,ij->i", apart, apart)
    return found


def _exact(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The same, in Python's integers where 64 bits might not do."""
    try:
        return squared(vectors, centroids)
    except OverflowError:
        v = vectors.astype(object)
        return np.stack([((v - c) ** 2).sum(1) for c in centroids.astype(object)], axis=1)


def build_tree(centroids: np.ndarray, leaf: int = 8) -> Tree:
    """Split at the median distance from a vantage point until ``leaf`` centroids are left."""
    nodes: list[_Node] = []

    def grow(numbers: np.ndarray) -> int:
        at = len(nodes)
        if len(numbers) <= leaf:
            nodes.append(_Node(numbers))
            return at
        # The centroid farthest from the first one spreads the others best.
        vantage = int(_exact(centroids[numbers], centroids[numbers[:1]])[:, 0].argmax())
        rest = np.delete(numbers, vantage)
        apart = _exact(centroids[rest], centroids[numbers[vantage]][None])[:, 0]
        order = np.argsort(apart, kind="stable")
        nodes.append(_Node(numbers[vantage : vantage + 1]))
        halves = [half for half in np.array_split(order, 2) if len(half)]
        nodes[at].children = tuple(
            # In ascending order, so that of equally near centroids of a leaf the first has the smaller number.
            (grow(np.sort(rest[half])), float(apart[half].min()) ** 0.5, float(apart[half].max()) ** 0.5) for half in halves
        )
        return at

    grow(np.arange(len(centroids)))
    return Tree(centroids, nodes)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (the smallest of ties) and its squared distance."""
    best = np.full(len(vectors), _FAR, np.int64)
    number = np.full(len(vectors), len(tree.centroids), np.int64)
    # Lower bounds on the distance to the centroids of open nodes; closed ones are infinite.
    bounds = np.full((len(vectors), len(tree.nodes)), np.inf)
    bounds[:, 0] = 0.0
    live = np.arange(len(vectors))
    while len(live):
        at = bounds[live].argmin(1)
        low = bounds[live, at]
        # Bounds were drawn down past rounding, so an equal distance is never missed.
        going = low <= np.sqrt(best[live].astype(np.float64))
        going &= np.isfinite(low)
        live, at, low = live[going], at[going], low[going]
        for i in np.unique(at):
            node, rows, base = tree.nodes[i], live[at == i], low[at == i]
            bounds[rows, i] = np.inf
            found = _exact(vectors[rows], tree.centroids[node.numbers])
            column = found.argmin(1)  # numbers of a leaf ascend, so ties go to the smaller one
            apart, who = found[np.arange(len(rows)), column], node.numbers[column]
            distance = np.sqrt(apart.astype(np.float64))
            apart = np.minimum(apart, _FAR).astype(np.int64)
            better = (apart < best[rows]) | ((apart == best[rows]) & (who < number[rows]))
            best[rows[better]], number[rows[better]] = apart[better], who[better]
            if node.children:
                for child, near, far in node.children:
                    gap = np.maximum(distance - far, near - distance) - 1e-12 * (distance + far)
                    bounds[rows, child] = np.maximum(base, gap)
    if (best == _FAR).any():
        raise OverflowError("a squared distance does not fit into 64 bits")
    return number, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    found = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if (np.abs(found) >= _WIDEST).any():
        raise OverflowError("a component does not fit into 61 bits")
    return found


def _blocks(batch: pa.RecordBatch, tree: Tree) -> Iterator[pa.RecordBatch]:
    """Slices whose table of bounds stays below some 32 MB."""
    rows = max(1, (4 << 20) // max(64, len(tree.nodes)))
    yield from (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))


def _partial_sums(tree: Broadcast, width: int):
    """Sums and sizes of a task's share of each cluster; component -1 carries none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value.centroids)
        sums, sizes, most = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for part in _blocks(batch, tree.value):
                vectors = _matrix(part.column("q"), width)
                number, _ = nearest(tree.value, vectors)
                order = np.argsort(number, kind="stable")
                cut = np.flatnonzero(np.diff(number[order], prepend=-1))
                sums[number[order][cut]] += np.add.reduceat(vectors[order].astype(np.int64), cut, axis=0)
                sizes += np.bincount(number, minlength=k)
                most = max(most, int(np.abs(vectors).max(initial=0)))
                if most * int(sizes.max()) >= 2**63:
                    raise OverflowError("a sum of components may not fit into 64 bits")
        held = np.flatnonzero(sizes)
        n = len(held) * width
        yield pa.record_batch(
            [
                pa.array(np.repeat(held, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width), len(held)).astype(np.int32)),
                pa.array(sums[held].reshape(n)),
                pa.array(np.repeat(sizes[held], width)),
            ],
            names=["cluster", "component", "total", "n"],
        )

    return run


def _assignments(tree: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, tree.value):
                number, apart = nearest(tree.value, _matrix(part.column("q"), width))
                yield pa.record_batch(
                    [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(apart)],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def quantized(vectors: DataFrame, width: int, scale: float, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Vectors of ``width`` finite components as integers floor(scale * x): vec_id, q."""
    v = F.col("v")
    return (
        vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
        .filter(F.size("v") == width)
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("q"))
    )


def _first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; ties by components, rows without an id last."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([row.q for row in rows], np.int64)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    width: int = 64,
    scale: float = 256.0,
    salt: str = "2:",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A component x counts as floor(scale * x); distances are squared Euclidean
    ones of such integers, of equally near centroids the smaller number wins. The
    first centroids are the k vectors with the smallest sha256 of ``salt`` and
    id; each round replaces every centroid by the floor of its vectors' mean, and
    one without vectors stays. Null vectors, vectors of another width, and those
    with null or non-finite components take no part. Repeated rows count as often
    as they occur and get equal rows; rows without an id are clustered, but come
    last when first centroids are chosen. With fewer than k vectors there are as
    many centroids as vectors, and an empty table gives an empty result. A
    distance beyond 64 bits is an error. Other columns are ignored.
    """
    if k * width * 16 > MAX_TREE_BYTES:
        raise ValueError("centroids exceed what every worker may hold")
    spark = vectors.sparkSession
    kept = materialize(quantized(vectors, width, scale, id_column, vector_column), work_path(spark, "vectors"))
    centroids = _first_centroids(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(build_tree(centroids))
        partial = kept.select("q").mapInArrow(_partial_sums(tree, width), _SUMS)
        sums = partial.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        for row in sums:  # k * width rows
            centroids[row.cluster, row.component] = row.total // row.n
        tree.unpersist()
    tree = spark.sparkContext.broadcast(build_tree(centroids))
    assigned = materialize(
        kept.mapInArrow(_assignments(tree, width), "vec_id bigint, cluster int, distance bigint"), work_path(spark, "clusters")
    )
    marks = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(marks, "cluster int, centroid_sha256 string")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance").alias("inertia"))
    facts = inertia.join(named, "cluster").withColumn("inertia", whole.scalar())
    # One row per centroid, k at most.
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
