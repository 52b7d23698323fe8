"""The streaming feature job and its error limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.extract import ERROR, errors_of, extract_features, features_of
from tidemill.operators.validate import invalid_of, valid_of, validate_features
from tidemill.plans.features import FeatureSettings
from tidemill.session import make_folder, spread, spread_parts
from tidemill.sinks.files import write_json_lines
from tidemill.sinks.keyed import KeyedTable
from tidemill.sinks.tables import Outputs, append_tables, write_to_store
from tidemill.streaming.windows import aggregate_stream, output_mode


def start_file_query(
    df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append", keys: tuple[str, ...] = ("user_id",), **trigger
) -> StreamingQuery:
    """Append a stream to files; ``update`` output is merged by ``keys`` into a keyed Parquet table instead."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if mode == "update":

        def merge(batch: DataFrame, batch_id: int) -> None:
            KeyedTable(batch.sparkSession, path, df.schema, list(keys)).merge(batch)

        return writer.foreachBatch(merge).start()
    return writer.format(kind).start(path)


class TooManyErrors(RuntimeError):
    """The dead-letter limits of a stream were passed."""


@dataclass
class ErrorLimits:
    """Stop after a number of errors or an error share, counted over all batches."""

    # Published limits.
    max_errors: int = 100
    max_percent: float = 5.0
    errors: int = 0
    rows: int = 0

    def add(self, errors: int, rows: int) -> None:
        self.errors += errors
        self.rows += rows
        share = 100.0 * self.errors / self.rows if self.rows else 0.0
        if self.errors > self.max_errors or share > self.max_percent:
            raise TooManyErrors(f"{self.errors} errors in {self.rows} rows ({share:.2f} %)")


def start_feature_job(
    source: DataFrame,
    root: str,
    checkpoint: str,
    settings: FeatureSettings = FeatureSettings(),
    document: str | None = None,
    limits: ErrorLimits | None = None,
    output: str = "tables",
    **trigger,
) -> list[StreamingQuery]:
    """Start the two queries of the job on one source definition.

    The first writes features, errors and invalid rows per micro-batch; each
    batch is extracted once and kept while its outputs are written. The second
    aggregates valid features over event-time windows. Both recover from their
    own checkpoint, and a repeated batch overwrites its own folder. Where the job
    ends with what is there (``availableNow`` or ``once``) and features go to
    tables, the second starts when the first is done and streams from its
    features table, so that documents are extracted once.

    ``output`` sends valid features to append ``tables``, to JSON lines in
    ``files``, to the feature ``store`` below ``root``, or to tables and store
    with ``both``.
    """
    if output not in ("tables", "files", "store", "both"):
        raise ValueError(f"no output is called {output}")
    trigger = trigger or {"availableNow": True}
    now = settings.processing_time

    def write(batch: DataFrame, batch_id: int) -> None:
        extracted = extract_features(batch, document, now, settings.domain)
        counted = Observation(f"batch-{batch_id}")
        kept = extracted.observe(
            counted,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(ERROR).isNotNull()).alias("errors"),
        ).persist()
        try:
            checked = validate_features(features_of(kept), settings.rules)
            outputs = Outputs(valid_of(checked), errors_of(kept, now), invalid_of(checked))
            if output in ("tables", "both"):
                append_tables(outputs, root, batch_id)
            if output == "files":
                for name, rows in outputs.frames().items():
                    write_json_lines(rows, f"{root}/{name}/batch={batch_id}", "overwrite")
            if output in ("store", "both"):
                write_to_store(
                    batch.sparkSession,
                    outputs.features,
                    f"{root}/store",
                    "transaction_features",
                    processing_time=now,
                    order=["event_time", "message_id"],
                    batch_id=batch_id,
                    dead_letter_path=f"{root}/dead_letters",
                )
            if limits is not None:
                limits.add(counted.get["errors"], counted.get["rows"])
        finally:
            kept.unpersist()

    records = (
        source.writeStream.option("checkpointLocation", f"{checkpoint}/records")
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )
    window = settings.window
    if window is None:
        return [records]
    extracted = features_of(extract_features(source, document, now, settings.domain))
    valid = valid_of(validate_features(extracted, settings.rules))
    if output in ("tables", "both") and (trigger.get("availableNow") or trigger.get("once")):
        # Only finished batches: a folder that a repeat would overwrite is never read.
        finish([records])
        valid = read_written_features(source.sparkSession, f"{root}/features", valid)
    aggregates = start_file_query(
        aggregate_stream(valid, window),
        f"{root}/aggregated_features",
        f"{checkpoint}/aggregates",
        mode=output_mode(window),
        **trigger,
    )
    return [records, aggregates]


def read_written_features(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stream over the features that batches have written, whatever their age; columns as in ``like``."""
    make_folder(spark, path)
    rows = spark.readStream.schema(like.schema).option("maxFileAge", "36500d").parquet(path)
    return rows.select(*like.columns)


def finish(queries: list[StreamingQuery]) -> None:
    """Wait for every query; the first failure stops the others and is raised."""
    try:
        for query in queries:
            query.awaitTermination()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over one of the supplied Parquet tables, file or folder, its rows spread over tasks."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern keeps the source from taking a single file for a partition root.
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    return spread(rows, spread_parts(spark, folder, name))
