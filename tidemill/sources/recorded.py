"""Recorded topics: broker records in Parquet files, streamed by offset like a broker's own.

A recording is a folder with ``topic=…/partition=…`` subfolders of files that
hold the records with their offsets, as :func:`record_topics` writes them. New
files are new records. The source keeps one offset per topic and partition in
the query's checkpoint, so a query that restarts goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "recorded_topics"
SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
)
_FIELDS = ("key", "value", "offset", "timestamp", "timestampType")


def record_topics(records: DataFrame, path: str) -> None:
    """Append records with Kafka's columns to a recording, each partition in order of its offsets."""
    from pyspark.sql import functions as F

    kind = F.col("timestampType") if "timestampType" in records.columns else F.lit(0)
    rows = records.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        "topic",
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        kind.cast("int").alias("timestampType"),
    )
    ordered = rows.repartitionByRange("topic", "partition", "offset").sortWithinPartitions("topic", "partition", "offset")
    ordered.write.mode("append").partitionBy("topic", "partition").parquet(path)


@dataclass(frozen=True)
class _Segment:
    topic: str
    partition: int
    file: str
    first: int
    last: int


@dataclass
class _Range(InputPartition):
    """Records of one file with offsets from ``start`` to before ``end``."""

    topic: str
    partition: int
    file: str
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, topics: list[str], starting: str, fail_on_loss: bool):
        self.path, self.topics, self.starting, self.fail_on_loss = path, topics, starting, fail_on_loss
        self.known: dict[str, _Segment] = {}

    def _store(self):
        store, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        return store, root

    def _segments(self) -> list[_Segment]:
        """All files of the topics; the footer of each is read once."""
        store, root = self._store()
        for topic in self.topics:
            for found in store.get_file_info(pafs.FileSelector(f"{root}/topic={topic}", allow_not_found=True, recursive=True)):
                folder = found.path.rsplit("/", 2)[-2]
                if found.type != pafs.FileType.File or found.base_name[0] in "._" or found.path in self.known:
                    continue
                meta = pq.read_metadata(found.path, filesystem=store)
                column = meta.schema.to_arrow_schema().get_field_index("offset")
                stats = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
                if stats:
                    first, last = min(s.min for s in stats), max(s.max for s in stats)
                    self.known[found.path] = _Segment(topic, int(unquote(folder.split("=", 1)[1])), found.path, first, last)
        return list(self.known.values())

    def _edges(self, end: bool) -> dict:
        edges: dict[str, dict[str, int]] = {topic: {} for topic in self.topics}
        for s in self._segments():
            held = edges[s.topic].get(str(s.partition))
            at = s.last + 1 if end else s.first
            edges[s.topic][str(s.partition)] = at if held is None else (max if end else min)(held, at)
        return edges

    def initialOffset(self) -> dict:  # noqa: N802
        return self._edges(end=self.starting == "latest")

    def latestOffset(self) -> dict:  # noqa: N802
        return self._edges(end=True)

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        segments = self._segments()
        found = []
        for topic, parts in end.items():
            for part, upto in parts.items():
                # A partition that was not there when the query began is read from its start.
                own = [s for s in segments if s.topic == topic and s.partition == int(part)]
                known = start.get(topic, {}).get(part)
                begin = min((s.first for s in own), default=0) if known is None else known
                if self.fail_on_loss and begin < upto and not any(s.first <= begin for s in own):
                    raise RuntimeError(f"records of {topic}-{part} from offset {begin} are gone")
                for s in own:
                    low, high = max(begin, s.first), min(upto, s.last + 1)
                    if low < high:
                        found.append(_Range(topic, int(part), s.file, low, high))
        return found

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        wanted = [("offset", ">=", partition.start), ("offset", "<", partition.end)]
        rows = pq.read_table(partition.file, columns=list(_FIELDS), filters=wanted, filesystem=store, partitioning=None)
        n = rows.num_rows
        columns = {name: rows.column(name) for name in _FIELDS}
        columns["timestamp"] = pc.cast(columns["timestamp"], pa.timestamp("us", "UTC"))
        columns |= {"topic": pa.array([partition.topic] * n, pa.string()), "partition": pa.array([partition.partition] * n, pa.int32())}
        names = [field.split(" ")[0] for field in SCHEMA.split(", ")]
        yield from pa.table({name: columns[name] for name in names}).to_batches()

    def commit(self, end: dict) -> None:
        pass


class RecordedTopics(DataSource):
    """Options: ``path``, ``topics`` (comma-separated), ``startingOffsets`` (``latest`` or ``earliest``), ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        starting = self.options.get("startingOffsets", "latest")
        if starting not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets is latest or earliest, not {starting}")
        topics = [t.strip() for t in self.options["topics"].split(",") if t.strip()]
        return _Reader(self.options["path"].rstrip("/"), topics, starting, self.options.get("failOnDataLoss", "true") == "true")


def read_recorded(
    spark: SparkSession, path: str, topics: list[str], starting: str = "latest", fail_on_loss: bool = True
) -> DataFrame:
    """Stream of a recording's records, with Kafka's columns.

    ``latest`` begins behind what is there when the query starts for the first
    time; partitions that appear later are read from their start.
    """
    spark.dataSource.register(RecordedTopics)
    return (
        spark.readStream.format(NAME)
        .options(path=path, topics=",".join(topics), startingOffsets=starting, failOnDataLoss=str(fail_on_loss).lower())
        .load()
    )
