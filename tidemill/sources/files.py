"""File sources: JSON lines, JSON arrays, training files and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.config import ModelDefinition
from tidemill.operators.joins import missing_columns

TRANSACTION_SCHEMA = (
    "transaction_id string, user_id string, timestamp string, amount double, "
    "merchant_id string, merchant_category string, payment_method string, "
    "location struct<city:string,state:string,country:string,zip_code:string>, "
    "features struct<hour_of_day:int,day_of_week:int,is_weekend:boolean,"
    "transaction_count_24h:int,avg_amount_30d:double>, label int"
)


def read_json_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Documents of JSON-line files as a VARIANT; lines that do not parse are dropped.

    ``value`` keeps the line itself for error records.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path)
    # One parse per line: a filter on the parsed column would parse it twice.
    return lines.withColumn("doc", F.explode(F.array_compact(F.array(F.try_parse_json("value")))))


def read_json_shards(spark: SparkSession, prefix: str, schema: str | StructType) -> DataFrame:
    """Rows of all ``prefix*.json`` shards with a fixed schema.

    Blank lines are skipped, a broken line fails the read, and a prefix that
    matches nothing is an error.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{prefix}*.json")


def read_json_array(spark: SparkSession, path: str, schema: str = TRANSACTION_SCHEMA) -> DataFrame:
    """Rows of files that each hold one JSON array.

    A file with one array cannot be split; many files are read side by side.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_training_file(spark: SparkSession, path: str, model: ModelDefinition) -> DataFrame:
    """Training table from Parquet or CSV by extension.

    CSV text of the model's columns is read as numbers without a pass to infer
    types. When columns of the model are missing, every other column counts as
    a feature and types are inferred. Whole numbers become doubles.
    """
    wanted = [*model.columns, model.target]
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).csv(path)
        if missing_columns(df, wanted):
            df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        else:
            df = df.select(*[F.col(c).try_cast("double").alias(c) for c in wanted])
    features = list(model.columns)
    if missing_columns(df, wanted):
        features = [c for c in df.columns if c != model.target]
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.col(c).cast("double").alias(c) if kinds[c] in ("int", "bigint") else F.col(c)
            for c in features
        ],
        F.col(model.target).cast("int").alias(model.target),
    )


def read_labels(
    spark: SparkSession, path: str, id_column: str = "message_id", label_column: str = "label"
) -> DataFrame:
    """Id and label columns of CSV files with a header, whatever their order."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(id_column, F.col(label_column).try_cast("int").alias(label_column))
