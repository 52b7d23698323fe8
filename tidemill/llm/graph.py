"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize, work_path


def components(edges: DataFrame) -> DataFrame:
    """Label of every node of ``edges`` (a, b): node, label; the labels are nodes.

    Each round hooks a node to its smallest neighbour and contracts the edges.
    Ids should be hashes: then a constant share of the nodes goes in each round,
    on paths and hubs alike. Edges and labels stay distributed; the driver only
    sees whether edges are left. Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    left = edges.select("a", "b").filter("a <> b")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        left = materialize(left, work_path(spark, "component-edges"))
        if left.isEmpty():
            return labels
        hooks = (
            left.select(F.explode(F.expr("array(struct(a, b), struct(b as a, a as b))")).alias("e"))
            .groupBy(F.col("e.a").alias("old"))
            .agg(F.min("e.b").alias("nearest"))
            .select("old", F.least("old", "nearest").alias("new"))
        )
        hooks = materialize(hooks, work_path(spark, "component-hooks"))
        labels = labels.join(hooks, F.col("label") == F.col("old"), "left").select(
            "node", F.coalesce("new", "label").alias("label")
        )
        labels = materialize(labels, work_path(spark, "component-labels"))
        to_a, to_b = (hooks.select(F.col("old").alias(f"old_{x}"), F.col("new").alias(f"new_{x}")) for x in "ab")
        left = (
            left.join(to_a, F.col("a") == F.col("old_a"))
            .join(to_b, F.col("b") == F.col("old_b"))
            .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
            .filter("a <> b")
            .distinct()
        )
