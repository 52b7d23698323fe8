"""The feature store: one row per entity and group, features in one map.

Map values are JSON text, so a JSON null is the text ``null`` and overwrites an
older value, as merging JSON objects does. Reads do not look at the expiry
time; only :func:`expire` acts on it, and the next write makes a row active
again.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.transforms import TransformRegistry
from tidemill.operators.extract import moment
from tidemill.session import discard, exists, materialize, work_path

KEY = ["entity_id", "feature_group"]
STORE_SCHEMA = (
    "entity_id string, feature_group string, features map<string,string>, "
    "event_timestamp timestamp, ingestion_timestamp timestamp, "
    "ttl_timestamp timestamp, is_active boolean"
)
# Record metadata that is not stored as a feature.
METADATA_FIELDS = ("message_id", "timestamp", "processed_at")


def json_value(column: Column, kind: str) -> Column:
    """A scalar as JSON text; null becomes the text ``null``."""
    if kind == "string":
        # to_json has no scalar form: wrap the text and cut the wrapper off.
        wrapped = F.to_json(F.struct(column.alias("v")))
        text = wrapped.substr(F.lit(6), F.length(wrapped) - 6)
    elif kind in ("timestamp", "timestamp_ntz", "date"):
        text = F.concat(F.lit('"'), column.cast("string"), F.lit('"'))
    elif kind.startswith(("struct", "array", "map")):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.when(column.isNull(), F.lit("null")).otherwise(text)


def json_text(value: Column) -> Column:
    """The plain value of JSON text; null for the text ``null``."""
    document = F.try_parse_json(value)
    return F.when(~F.is_variant_null(document), F.try_variant_get(document, "$", "string"))


def pack_features(
    df: DataFrame,
    group: str,
    entity: str = "user_id",
    event_time: Column | str | dt.datetime | None = None,
    processing_time: Column | str | dt.datetime | None = None,
    ttl_seconds: int = 86400,
    order: list[str] | None = None,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Feature rows as store rows: metadata dropped, the rest in a map.

    Rows without a usable entity are left out; they are dead letters. ``order``
    is the arrival order inside a batch. All rows have the same names, so with an
    order the last row of an entity stands for all of its rows, and only this one
    is turned into a map.
    """
    now = moment(processing_time)
    out = {entity, *METADATA_FIELDS, *drop}
    kinds = [(name, kind) for name, kind in df.dtypes if name not in out]
    pairs = [p for name, kind in kinds for p in (F.lit(name), json_value(F.col(name), kind))]
    when = now if event_time is None else (F.col(event_time) if isinstance(event_time, str) else moment(event_time))
    usable = df.filter(F.col(entity).isNotNull() & (F.col(entity) != "unknown"))
    return (latest_rows(usable, entity, order) if order else usable).select(
        F.col(entity).cast("string").alias("entity_id"),
        F.lit(group).alias("feature_group"),
        F.create_map(*pairs).alias("features"),
        when.cast("timestamp").alias("event_timestamp"),
        now.alias("ingestion_timestamp"),
        (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("ttl_timestamp"),
        F.lit(True).alias("is_active"),
        F.struct(*(order or [F.lit(0)])).alias("_order"),
    )


def latest_rows(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """The last row of each entity in an order; equal places go by a hash of the row, so reruns agree.

    The maximum combines before the shuffle, so an entity sends one row per task.
    """
    hashed = [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.struct(*order, F.xxhash64(*hashed))
    last = df.groupBy(F.col(entity).alias("_entity")).agg(F.max_by(F.struct(*df.columns), place).alias("_row"))
    return last.select("_row.*")


def fold_batch(batch: DataFrame) -> DataFrame:
    """One row per key of a batch, later rows over earlier ones.

    Rows are exploded to names and each name keeps its latest value; one more
    entry without a name carries the times, so the batch is read once. The
    maximum combines before the shuffle, so an entity that fills a third of
    the batch sends one value per name and task.
    """
    times = ("event_timestamp", "ingestion_timestamp", "ttl_timestamp")
    entry = "array<struct<key:string,value:string>>"
    entries = F.concat(
        F.coalesce(F.map_entries("features"), F.array().cast(entry)).cast(entry),
        F.array(F.lit(None).cast("struct<key:string,value:string>")),
    )
    rows = batch.select(*KEY, "_order", *times, F.explode(entries).alias("e")).select(
        *KEY,
        F.col("e.key").alias("name"),
        F.struct("_order", F.col("e.value").alias("value"), *[F.when(F.col("e").isNull(), F.col(t)).alias(t) for t in times]).alias("_v"),
    )
    latest = rows.groupBy(*KEY, "name").agg(F.max("_v").alias("_v"))
    named = F.when(F.col("name").isNotNull(), F.struct("name", F.col("_v.value").alias("value")))
    folded = latest.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(named)).alias("features"),
        F.max(F.when(F.col("name").isNull(), F.struct(*[F.col(f"_v.{t}").alias(t) for t in times]))).alias("_t"),
    )
    return folded.select(*KEY, "features", *[F.col(f"_t.{t}").alias(t) for t in times], F.lit(True).alias("is_active"))


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two maps in which the second wins."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, empty)
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def upsert(store: DataFrame, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
    """New state of the store after a batch.

    New names overwrite old ones, old names stay, times are replaced and the
    row is active again. One full join on the key; nothing else is shuffled.
    With a ``batch_id`` the store has a column of that name, the last batch that
    wrote the row, and a row that this or a later batch has written stays as it is.
    """
    values = ("features", "event_timestamp", "ingestion_timestamp", "ttl_timestamp", "is_active")
    new = fold_batch(batch).withColumnsRenamed({c: f"_n_{c}" for c in values}).withColumn("_new", F.lit(True))
    joined = store.join(new, KEY, "full")
    fresh = F.col("_new").isNotNull()
    columns = []
    if batch_id is not None:
        fresh = fresh & (F.col("batch_id").isNull() | (F.col("batch_id") < batch_id))
        columns = [F.when(fresh, F.lit(batch_id).cast("bigint")).otherwise(F.col("batch_id")).alias("batch_id")]
    merged = merge_maps(F.col("features"), F.col("_n_features"))
    return joined.select(
        *KEY,
        F.when(fresh, merged).otherwise(F.col("features")).alias("features"),
        *[F.when(fresh, F.coalesce(f"_n_{c}", c)).otherwise(F.col(c)).alias(c) for c in values[1:]],
        *columns,
    )


def active_rows(store: DataFrame, group: str) -> DataFrame:
    return store.filter((F.col("feature_group") == group) & F.col("is_active"))


def select_names(features: Column, names: list[str] | None) -> Column:
    """Map restricted to the named features; all of them when no names are given."""
    if not names:
        return features
    return F.map_filter(features, lambda k, _: k.isin(*names))


def get_features(store: DataFrame, entity: str, group: str, names: list[str] | None = None) -> DataFrame:
    """The active row of one key, or no row."""
    return (
        active_rows(store, group)
        .filter(F.col("entity_id") == entity)
        .select("entity_id", select_names(F.col("features"), names).alias("features"))
    )


def get_batch(
    store: DataFrame, entities: DataFrame, group: str, names: list[str] | None = None
) -> DataFrame:
    """Active rows of many entities; ids without a row are absent."""
    ids = entities.select("entity_id").distinct()
    return (
        active_rows(store, group)
        .join(ids, "entity_id", "left_semi")
        .select("entity_id", select_names(F.col("features"), names).alias("features"))
    )


def wide_features(
    store: DataFrame, group: str, names: list[str], key: str = "user_id", numeric: list[str] | None = None
) -> DataFrame:
    """Named features as columns, without a pivot; ``numeric`` ones as doubles."""
    numeric = names if numeric is None else numeric
    columns = []
    for name in names:
        text = json_text(F.try_element_at("features", F.lit(name)))
        columns.append((text.try_cast("double") if name in numeric else text).alias(name))
    rows = active_rows(store, group).filter(F.size("features") > 0)
    return rows.select(F.col("entity_id").alias(key), *columns)


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Soft delete: rows whose key is listed become inactive."""
    gone = keys.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    return store.join(gone, KEY, "left").select(
        *[c for c in store.columns if c != "is_active"],
        (F.col("is_active") & F.col("_gone").isNull()).alias("is_active"),
    )


def expire(store: DataFrame, now: Column | str | dt.datetime) -> DataFrame:
    """Rows past their expiry time become inactive."""
    return store.withColumn("is_active", F.col("is_active") & ~_expired(now))


def _expired(now: Column | str | dt.datetime) -> Column:
    return F.coalesce(F.col("ttl_timestamp") <= moment(now), F.lit(False))


def expired_count(store: DataFrame, now: Column | str | dt.datetime) -> DataFrame:
    """How many active rows an expiry run would turn off."""
    return store.agg(F.count_if(F.col("is_active") & _expired(now)).alias("expired"))


def feature_vectors(
    store: DataFrame,
    entities: DataFrame,
    schema: dict[str, tuple[str, ...]],
    default: float | None = 0.0,
    transforms: TransformRegistry | None = None,
) -> DataFrame:
    """One row per entity with a ``group_feature`` column for every feature.

    The groups are gathered in one conditional aggregate and joined once,
    whatever their number. A missing entity or feature takes the default;
    a stored null stays null.
    """
    groups = list(schema)
    gathered = (
        store.filter(F.col("feature_group").isin(*groups) & F.col("is_active"))
        .groupBy("entity_id")
        .agg(
            *[
                F.first(F.when(F.col("feature_group") == g, F.col("features")), ignorenulls=True).alias(f"_{i}")
                for i, g in enumerate(groups)
            ]
        )
    )
    joined = entities.select("entity_id").distinct().join(gathered, "entity_id", "left")
    raw = joined
    kinds = {}
    for i, group in enumerate(groups):
        for name in schema[group]:
            column = f"{group}_{name}"
            kinds[column] = (i, name)
            raw = raw.withColumn(column, json_text(F.try_element_at(f"_{i}", F.lit(name))))
    present = {
        c: F.coalesce(F.map_contains_key(F.col(f"_{i}"), name), F.lit(False)) for c, (i, name) in kinds.items()
    }
    columns = []
    types = dict(raw.dtypes)
    for column, (_, name) in kinds.items():
        value = F.col(column)
        if transforms is not None and name in transforms.transforms:
            value = transforms.transforms[name](value, types[column])
        value = value.try_cast("double")
        if default is not None:
            value = F.when(present[column], value).otherwise(F.lit(float(default)))
        columns.append(value.alias(column))
    return raw.select("entity_id", *columns)


def serving_features(
    store: DataFrame, requests: DataFrame, groups: list[str], body: str = "features"
) -> DataFrame:
    """Request rows with one merged map: later groups win, the body wins last."""
    merged = requests
    for i, group in enumerate(groups):
        rows = active_rows(store, group).select("entity_id", F.col("features").alias(f"_g{i}"))
        merged = merged.join(rows, "entity_id", "left")
    features = F.lit(None).cast("map<string,string>")
    for i in range(len(groups)):
        features = merge_maps(features, F.col(f"_g{i}"))
    features = merge_maps(features, F.col(body))
    return merged.withColumn("_merged", features).drop(body, *[f"_g{i}" for i in range(len(groups))]).withColumnRenamed("_merged", body)


def group_statistics(store: DataFrame) -> DataFrame:
    """Entities, rows, rows per feature and the sum over features of each group."""
    live = store.filter("is_active")
    totals = live.groupBy("feature_group").agg(
        F.count_distinct("entity_id").alias("unique_entities"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.size("features")).cast("bigint").alias("total_features"),
    )
    counts = (
        live.select("feature_group", F.explode(F.map_keys("features")).alias("feature"))
        .groupBy("feature_group", "feature")
        .agg(F.count(F.lit(1)).alias("feature_count"))
    )
    return counts.join(totals, "feature_group")


def group_counts(store: DataFrame) -> DataFrame:
    """Distinct entities per group, active or not."""
    return store.groupBy("feature_group").agg(F.count_distinct("entity_id").alias("entities"))


def group_list(store: DataFrame) -> DataFrame:
    return store.select("feature_group").distinct()


def entity_listing(store: DataFrame, limit: int = 100) -> DataFrame:
    """Features and last ingestion per entity, first ``limit`` in order."""
    return (
        store.groupBy("entity_id")
        .agg(
            F.sum(F.size("features")).cast("bigint").alias("feature_count"),
            F.max("ingestion_timestamp").alias("last_update"),
        )
        .orderBy("entity_id")
        .limit(limit)
    )


def store_summary(store: DataFrame) -> DataFrame:
    """Entities and features per group, and a row for the grand total."""
    return (
        store.rollup("feature_group")
        .agg(
            F.count_distinct("entity_id").alias("entities"),
            F.sum(F.size("features")).cast("bigint").alias("features"),
        )
        .withColumn("feature_group", F.coalesce("feature_group", F.lit("TOTAL")))
    )


def eav_to_rows(df: DataFrame) -> DataFrame:
    """Entity-attribute-value rows to one map per entity and group."""
    latest = df.groupBy(*KEY, "feature_name").agg(
        F.max(F.struct("event_timestamp", "feature_value"))["feature_value"].alias("value")
    )
    return latest.groupBy(*KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_name", "value")))).alias("features")
    )


def infer_numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row: for each text column, is more than half of it readable as a number?"""
    names = [n for n, kind in df.dtypes if kind == "string" and n not in exclude]
    return df.agg(
        *[(F.avg(F.col(n).try_cast("double").isNotNull().cast("int")) > 0.5).alias(n) for n in names]
    )


#: Parts of a group in a stored table; an entity's hash names its part.
STORE_PARTS = 64


class FeatureTable:
    """A store kept as one Parquet table, partitioned by group and part of the entities.

    A write computes the new rows of the partitions it touches, writes them below
    the session's shared folder, and then has Spark overwrite these partitions and
    no others. Rows keep the number of the last batch that wrote them, so a batch
    that is delivered again, or was only partly in place, is settled by its number;
    numbers of a group must grow. One writer per table at a time, and ``parts``
    must stay the same for a table. A driver that dies while Spark puts partitions
    in place leaves their new rows in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = STORE_PARTS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.parts = parts

    def _rows(self) -> DataFrame:
        schema = f"{STORE_SCHEMA}, batch_id bigint, part int"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().select(*[f.split(" ")[0] for f in STORE_SCHEMA.split(", ")])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("entity_id"), F.lit(self.parts)).cast("int")

    def _within(self, touched: DataFrame) -> DataFrame:
        """Rows of the partitions that ``touched`` names, one row per partition."""
        by_group: dict[str, list[int]] = {}
        for row in touched.select("feature_group", "part").collect():
            by_group.setdefault(row["feature_group"], []).append(row["part"])
        tests = [F.col("feature_group").eqNullSafe(group) & F.col("part").isin(parts) for group, parts in by_group.items()]
        return self._rows().filter(reduce(lambda a, b: a | b, tests, F.lit(False)))

    def _put(self, state: DataFrame) -> None:
        """Overwrite the partitions that ``state`` holds; it is computed in full before any is."""
        kept = work_path(self.spark, "store-state")
        rows = state.withColumn("part", self._part()).repartition("feature_group", "part")
        (
            materialize(rows, kept)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("feature_group", "part")
            .parquet(self.path)
        )
        discard(self.spark, kept)

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> "FeatureTable":
        """Merge a batch; partitions without any of its entities are neither read nor written.

        The batch is computed once; its partitions and its rows come from the files.
        """
        kept = work_path(self.spark, "store-batch")
        batch = materialize(batch, kept)
        old = self._within(batch.select("feature_group", self._part().alias("part")).distinct()).drop("part")
        if batch_id is None:
            last = old.select(*KEY, "batch_id")
            self._put(upsert(old.drop("batch_id"), batch).join(last, KEY, "left"))
        else:
            self._put(upsert(old, batch, batch_id))
        discard(self.spark, kept)
        return self

    def delete(self, keys: DataFrame) -> "FeatureTable":
        old = self._within(keys.select("feature_group", self._part().alias("part")).distinct())
        self._put(delete(old.drop("part"), keys))
        return self

    def expire(self, now) -> int:
        """Switch off what has run out; returns how many rows that were.

        Only partitions with such rows are written again.
        """
        due = self._rows().filter(F.col("is_active") & _expired(now)).groupBy("feature_group", "part").count()
        due = materialize(due, work_path(self.spark, "store-due"))
        count = due.agg(F.sum("count")).first()[0]
        if count:
            self._put(expire(self._within(due).drop("part"), now))
        return count or 0
