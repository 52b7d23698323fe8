"""A Parquet table with one row per key, of which a write replaces only the buckets it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import discard, exists, materialize, work_path


class KeyedTable:
    """Rows dealt to ``buckets`` folders by the hash of their keys; the number must stay the same.

    A merge reads the buckets of the keys it is given, takes the new rows in place
    of the old ones and has Spark overwrite these buckets and no others. Merging
    the same rows again changes nothing, so a micro-batch may be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        kind = self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0)).schema
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop("bucket")

    def merge(self, rows: DataFrame) -> None:
        """Take ``rows``, at most one per key, in place of the rows with their keys."""
        incoming, state = work_path(self.spark, "keyed-batch"), work_path(self.spark, "keyed-state")
        new = materialize(rows.withColumn("bucket", self._bucket()), incoming)
        touched = [row.bucket for row in new.select("bucket").distinct().collect()]
        if touched:
            renamed = new.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
            old = self._rows().filter(F.col("bucket").isin(touched)).join(renamed, same, "left_anti")
            merged = materialize(old.unionByName(new).repartition("bucket"), state)
            writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket").parquet(self.path)
        discard(self.spark, incoming, state)
