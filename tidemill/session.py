"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "tidemill",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators assume.

    Calendar fields are defined in UTC and adaptive execution picks join
    strategies, splits skewed partitions and sizes reducers at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # The JVM never compiles methods above 8000 bytes. Wide projections such
        # as feature extraction run faster as several small methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


def with_local_folder(spark: SparkSession) -> SparkSession:
    """Name a new folder of this machine where a local session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemill-"))
    return spark


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def with_method_limit(spark: SparkSession) -> SparkSession:
    """Give a session that keeps Spark's own limit of generated methods the one of :func:`build_session`."""
    if int(spark.conf.get(_METHOD_LIMIT)) > 8000:
        spark.conf.set(_METHOD_LIMIT, "8000")
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_root(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of Parquet per task where each row costs much CPU: the least, and the most once every core is busy.
SPREAD_BYTES = (256 << 10, 1 << 20)


def spread_parts(spark: SparkSession, folder: str, name: str) -> int:
    """Tasks that costly work on the rows of a supplied table should have; it grows with the table."""
    store, path = _in_store(spark, f"{folder}/{name}.parquet")
    size = store.getContentSummary(path).getLength()
    least, most = SPREAD_BYTES
    return min(-(-size // least), max(4 * spark.sparkContext.defaultParallelism, -(-size // most)))


def spread(df: DataFrame, parts: int) -> DataFrame:
    """The same rows in ``parts`` tasks, wherever the files keep them.

    Spark reads a row group in one task, however long its rows take afterwards. Rows
    are dealt by their content, so a repeated task deals them in the same way.
    """
    return df.repartition(parts, *df.columns) if parts > 1 else df


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the supplied tables, its rows spread for costly work on each."""
    return spread(table(spark, folder, name), spread_parts(spark, folder, name))


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a frame once and go on from the files.

    Jobs with several outputs use this instead of computing a costly frame once
    per output. The files outlive any executor, which a cache does not. Shuffle
    files of the write go when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def _in_store(spark: SparkSession, name: str):
    """A path and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete files of ``materialize`` that no frame reads any more."""
    for name in paths:
        store, path = _in_store(spark, name)
        store.delete(path, True)


def make_folder(spark: SparkSession, name: str) -> None:
    """Make a folder where there is none."""
    store, path = _in_store(spark, name)
    store.mkdirs(path)


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a file or folder is there."""
    store, path = _in_store(spark, name)
    return store.exists(path)
