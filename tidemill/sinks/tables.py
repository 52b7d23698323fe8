"""Multi-output sinks of the feature job: append tables and the feature store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.extract import dead_letters
from tidemill.operators.store import FeatureTable, pack_features


@dataclass(frozen=True)
class Outputs:
    """What one run or micro-batch of the feature job produces."""

    features: DataFrame
    errors: DataFrame
    invalid: DataFrame
    aggregated: DataFrame | None = None

    def frames(self) -> dict[str, DataFrame]:
        named = {
            "features": self.features,
            "errors": self.errors,
            "invalid_features": self.invalid,
            "aggregated_features": self.aggregated,
        }
        return {name: df for name, df in named.items() if df is not None}


def append_tables(outputs: Outputs, root: str, batch_id: int | str | None = None) -> None:
    """Append each output to its Parquet table below ``root``.

    With a batch id the rows go into a folder of that id which is overwritten
    when the batch is repeated, so a retry never doubles rows.
    """
    for name, df in outputs.frames().items():
        if batch_id is None:
            df.write.mode("append").parquet(f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")


def write_to_store(
    spark: SparkSession,
    rows: DataFrame,
    store_path: str,
    group: str,
    entity: str = "user_id",
    processing_time=None,
    ttl_seconds: int = 86400,
    order: list[str] | None = None,
    batch_id: int | None = None,
    dead_letter_path: str | None = None,
) -> DataFrame:
    """Merge rows into the store and append the unusable ones to dead letters.

    ``rows`` is read twice, by the store and by the dead letters; jobs pass a
    materialized frame.
    """
    batch = pack_features(
        rows,
        group,
        entity,
        processing_time=processing_time,
        ttl_seconds=ttl_seconds,
        order=order,
        drop=("event_time", "event_wall"),
    )
    FeatureTable(spark, store_path).upsert(batch, batch_id)
    dead = dead_letters(rows, entity, processing_time)
    if dead_letter_path is not None:
        target = dead_letter_path if batch_id is None else f"{dead_letter_path}/batch={batch_id}"
        dead.write.mode("append" if batch_id is None else "overwrite").parquet(target)
    return dead


def write_both(
    spark: SparkSession,
    outputs: Outputs,
    store_path: str,
    files_root: str,
    batch_id: int,
    processing_time=None,
    order: list[str] | None = None,
) -> None:
    """Store and files from one run; the batch id makes both repeatable."""
    write_to_store(
        spark,
        outputs.features,
        store_path,
        "transaction_features",
        processing_time=processing_time,
        order=order,
        batch_id=batch_id,
        dead_letter_path=f"{files_root}/dead_letters",
    )
    if outputs.aggregated is not None:
        write_to_store(
            spark,
            outputs.aggregated,
            store_path,
            "aggregated_features",
            processing_time=processing_time,
            batch_id=batch_id,
        )
    for name, df in outputs.frames().items():
        df.write.mode("overwrite").json(f"{files_root}/{name}/batch={batch_id}")


def count_rows(outputs: Outputs) -> dict[str, int]:
    """Rows per output, one aggregate each."""
    return {name: df.agg(F.count(F.lit(1))).first()[0] for name, df in outputs.frames().items()}
