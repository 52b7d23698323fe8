"""Feature-store operators over customers and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.registry import NOW, query, r7, tx, with_
from tidemill.functions.transforms import Numeric, TransformRegistry
from tidemill.operators import store as S
from tidemill.session import table, work_path

EARLY, LATE = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
CUT = "1997-01-01"
# Group "profile": every customer twice, the second time with fewer names and a
# null. Group "orders": totals before and from the cut date.
STORE = f"""profile AS (
    SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'profile' AS feature_group,
      CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS acctbal,
      CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey AS nation,
      CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '{LATE}' ELSE TIMESTAMP '{EARLY}' END AS ingested FROM customer),
  halves AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderdate >= TIMESTAMP '{CUT}' AS late,
      count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS biggest FROM orders GROUP BY 1, 2),
  order_rows AS (SELECT entity_id, 'orders' AS feature_group, arg_max(n, late) AS n, arg_max(total, late) AS total,
      max(biggest) FILTER (WHERE NOT late) AS biggest, bool_or(late) AS has_late, bool_or(NOT late) AS has_early FROM halves GROUP BY entity_id),
  order_store AS (SELECT *, CASE WHEN has_late THEN TIMESTAMP '{LATE}' ELSE TIMESTAMP '{EARLY}' END AS ingested FROM order_rows)"""


def profile_batches(spark, folder):
    customer = table(spark, folder, "customer")
    first = customer.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
    )
    second = customer.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        (F.col("c_acctbal") + 1).alias("acctbal"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    return first, second


def order_batches(spark, folder):
    orders = table(spark, folder, "orders")
    late = F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")

    def totals(rows):
        return rows.groupBy(F.col("o_custkey").cast("string").alias("user_id"))

    first = totals(orders.filter(~late)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("biggest")
    )
    second = totals(orders.filter(late)).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return first, second


def store(spark, folder):
    """The store after both halves of both groups."""
    state = spark.createDataFrame([], S.STORE_SCHEMA)
    for group, batches in (
        ("profile", profile_batches(spark, folder)),
        ("orders", order_batches(spark, folder)),
    ):
        for rows, when in zip(batches, (EARLY, LATE)):
            state = S.upsert(state, S.pack_features(rows, group, processing_time=when))
    return state


def value(name):
    return S.json_text(F.try_element_at("features", F.lit(name)))


@query(
    "fs_upsert",
    with_(
        STORE,
        f"""SELECT entity_id, feature_group, {r7('acctbal')} AS acctbal, segment, CAST(nation AS VARCHAR) AS nation, NULL::BIGINT AS n,
             NULL::DOUBLE AS total, NULL::DOUBLE AS biggest, TRUE AS is_active, ingested AS ingestion_timestamp,
             ingested + INTERVAL 1 DAY AS ttl_timestamp FROM profile
           UNION ALL SELECT entity_id, feature_group, NULL, NULL, NULL, n, {r7('total')}, {r7('biggest')}, TRUE, ingested,
             ingested + INTERVAL 1 DAY FROM order_store""",
    ),
)
def fs_upsert(spark, folder):
    """New names win, old names stay, a null overwrites, times are replaced."""
    return store(spark, folder).select(
        "entity_id",
        "feature_group",
        value("acctbal").try_cast("double").alias("acctbal"),
        value("segment").alias("segment"),
        value("nation").alias("nation"),
        value("n").try_cast("bigint").alias("n"),
        value("total").try_cast("double").alias("total"),
        value("biggest").try_cast("double").alias("biggest"),
        "is_active",
        "ingestion_timestamp",
        "ttl_timestamp",
    )


@query(
    "fs_upsert_batch_order",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, arg_max(CAST(regexp_extract(props, '[0-9]+') AS VARCHAR), event_id) AS k,
         arg_max(event_type, event_id) AS event_type, count(*) > 0 AS merged FROM events GROUP BY user_id""",
)
def fs_upsert_batch_order(spark, folder):
    """Many rows of one key in one batch apply in arrival order."""
    rows = table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
    )
    batch = S.pack_features(rows, "events", processing_time=NOW, order=["event_id"], drop=("event_id",))
    state = S.upsert(spark.createDataFrame([], S.STORE_SCHEMA), batch)
    return state.select(
        "entity_id", value("k").alias("k"), value("event_type").alias("event_type"), F.lit(True).alias("merged")
    )


@query(
    "fs_get",
    with_(STORE, f"SELECT entity_id, {r7('acctbal')} AS acctbal, CAST(1 AS BIGINT) AS names FROM profile WHERE entity_id = '7'"),
)
def fs_get(spark, folder):
    """One key, one named feature."""
    return S.get_features(store(spark, folder), "7", "profile", ["acctbal"]).select(
        "entity_id", value("acctbal").try_cast("double").alias("acctbal"), F.size("features").alias("names")
    )


@query(
    "fs_get_batch",
    with_(
        STORE,
        f"""SELECT entity_id, n, {r7('total')} AS total FROM order_store
           WHERE entity_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
    ),
)
def fs_get_batch(spark, folder):
    """Active rows of many ids; ids without orders are absent."""
    ids = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return S.get_batch(store(spark, folder), ids, "orders", ["n", "total"]).select(
        "entity_id", value("n").try_cast("bigint").alias("n"), value("total").try_cast("double").alias("total")
    )


@query(
    "j_entity_lookup",
    with_(
        STORE,
        """SELECT entity_id, segment FROM profile WHERE entity_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)""",
    ),
)
def j_entity_lookup(spark, folder):
    ids = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("entity_id")
    )
    return S.get_batch(store(spark, folder), ids, "profile").select("entity_id", value("segment").alias("segment"))


@query(
    "fs_delete",
    with_(
        STORE,
        "SELECT entity_id, feature_group, CAST(entity_id AS BIGINT) % 5 <> 0 AS is_active FROM profile UNION ALL SELECT entity_id, feature_group, TRUE FROM order_store",
    ),
)
def fs_delete(spark, folder):
    gone = table(spark, folder, "customer").filter("c_custkey % 5 = 0").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.lit("profile").alias("feature_group")
    )
    return S.delete(store(spark, folder), gone).select("entity_id", "feature_group", "is_active")


@query(
    "fs_expire",
    with_(
        STORE,
        """SELECT feature_group, count(*) AS "rows", count(*) FILTER (WHERE ingested = TIMESTAMP '2024-01-20') AS active,
             (SELECT count(*) FILTER (WHERE ingested <> TIMESTAMP '2024-01-20') FROM
               (SELECT ingested FROM profile UNION ALL SELECT ingested FROM order_store)) AS expired_in_all
           FROM (SELECT feature_group, ingested FROM profile UNION ALL SELECT feature_group, ingested FROM order_store) GROUP BY feature_group""",
    ),
)
def fs_expire(spark, folder):
    """A day after the first half, its rows are past their time."""
    state = store(spark, folder)
    now = "2024-01-11 00:00:00"
    after = S.expire(state, now).groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_active").alias("active")
    )
    return after.withColumn("expired_in_all", S.expired_count(state, now).scalar())


VECTOR_SCHEMA = {"profile": ("acctbal", "nation", "absent"), "orders": ("n", "total")}


@query(
    "fs_vector",
    with_(
        STORE,
        f"""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, {r7('least(greatest(p.acctbal, 0), 5000) / 5000')} AS profile_acctbal,
             CAST(p.nation AS DOUBLE) AS profile_nation, 0.0::DOUBLE AS profile_absent,
             CAST(coalesce(o.n, 0) AS DOUBLE) AS orders_n, {r7('coalesce(o.total, 0)')} AS orders_total
           FROM customer LEFT JOIN profile p ON p.entity_id = CAST(c_custkey AS VARCHAR)
             LEFT JOIN order_store o ON o.entity_id = CAST(c_custkey AS VARCHAR)""",
    ),
)
def fs_vector(spark, folder):
    """Two groups with prefixes, defaults and a transform."""
    ids = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    transforms = TransformRegistry({"acctbal": Numeric(0, 5000, normalize=True)})
    return S.feature_vectors(store(spark, folder), ids, VECTOR_SCHEMA, 0.0, transforms)


@query(
    "j_vectors",
    with_(
        STORE,
        f"""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, {r7('p.acctbal')} AS profile_acctbal, CAST(o.n AS DOUBLE) AS orders_n
           FROM customer LEFT JOIN profile p ON p.entity_id = CAST(c_custkey AS VARCHAR)
             LEFT JOIN order_store o ON o.entity_id = CAST(c_custkey AS VARCHAR)""",
    ),
)
def j_vectors(spark, folder):
    """Without a default, missing features stay null."""
    ids = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return S.feature_vectors(store(spark, folder), ids, {"profile": ("acctbal",), "orders": ("n",)}, None)


@query(
    "j_serving_merge",
    with_(
        STORE,
        f"""SELECT p.entity_id, {r7('p.acctbal')} AS acctbal, 'body' AS segment, o.n,
             CAST(CASE WHEN o.entity_id IS NULL THEN 3 WHEN o.biggest IS NULL AND NOT has_early THEN 5 ELSE 6 END AS BIGINT) AS names
           FROM profile p LEFT JOIN order_store o ON p.entity_id = o.entity_id""",
    ),
)
def j_serving_merge(spark, folder):
    """Groups in order, then the request body on top."""
    requests = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"),
        F.create_map(F.lit("segment"), F.lit('"body"')).alias("features"),
    )
    merged = S.serving_features(store(spark, folder), requests, ["profile", "orders"])
    return merged.select(
        "entity_id",
        value("acctbal").try_cast("double").alias("acctbal"),
        value("segment").alias("segment"),
        value("n").try_cast("bigint").alias("n"),
        F.size("features").alias("names"),
    )


@query(
    "fs_from_features",
    with_(
        "t AS (SELECT CAST(event_id AS VARCHAR) AS message_id, user_id, value * 10 AS amount FROM events)",
        f"SELECT CAST(user_id AS VARCHAR) AS entity_id, {r7('sum(amount)')} AS amount, TRUE AS only_features FROM t GROUP BY user_id",
    ),
)
def fs_from_features(spark, folder):
    """Records packed to maps without their metadata."""
    rows = tx(spark, folder)
    packed = S.pack_features(rows, "transaction_features", processing_time=NOW)
    bad = F.array(*[F.lit(n) for n in (*S.METADATA_FIELDS, "user_id")])
    return packed.groupBy("entity_id").agg(
        F.sum(value("amount").try_cast("double")).alias("amount"),
        F.every(~F.arrays_overlap(F.map_keys("features"), bad)).alias("only_features"),
    )


@query(
    "fs_eav_to_wide",
    """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS priority,
         arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS status FROM orders GROUP BY o_custkey""",
)
def fs_eav_to_wide(spark, folder):
    """One row per feature and time to one map per entity, newest value each."""
    orders = table(spark, folder, "orders")
    eav = orders.select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.lit("orders").alias("feature_group"),
        F.col("o_orderdate").alias("event_timestamp"),
        F.explode(
            F.array(
                F.struct(F.lit("priority").alias("feature_name"), F.col("o_orderpriority").alias("feature_value")),
                F.struct(F.lit("status").alias("feature_name"), F.col("o_orderstatus").alias("feature_value")),
            )
        ).alias("f"),
    ).select("entity_id", "feature_group", "event_timestamp", "f.*")
    return S.eav_to_rows(eav).select(
        "entity_id", F.col("features")["priority"].alias("priority"), F.col("features")["status"].alias("status")
    )


@query(
    "feature_stats",
    with_(
        STORE,
        """, counts AS (SELECT 'profile' AS feature_group, f.feature, count(*) AS feature_count FROM profile, (VALUES ('acctbal'), ('segment'), ('nation')) f(feature) GROUP BY ALL
             UNION ALL SELECT 'orders', 'n', count(*) FROM order_store UNION ALL SELECT 'orders', 'total', count(*) FROM order_store
             UNION ALL SELECT 'orders', 'biggest', count(*) FROM order_store WHERE has_early)
           SELECT c.feature_group, feature, feature_count, e.unique_entities, e.unique_entities AS row_count,
             CAST(sum(feature_count) OVER (PARTITION BY c.feature_group) AS BIGINT) AS total_features
           FROM counts c JOIN (SELECT 'profile' AS feature_group, count(*) AS unique_entities FROM profile
             UNION ALL SELECT 'orders', count(*) FROM order_store) e ON e.feature_group = c.feature_group""",
    ).replace(" , counts", ", counts"),
)
def feature_stats(spark, folder):
    return S.group_statistics(store(spark, folder))


@query(
    "group_counts",
    with_(STORE, "SELECT feature_group, count(*) AS entities FROM (SELECT feature_group FROM profile UNION ALL SELECT feature_group FROM order_store) GROUP BY feature_group"),
)
def group_counts(spark, folder):
    """Inactive rows count too."""
    gone = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.lit("profile").alias("feature_group")
    )
    return S.group_counts(S.delete(store(spark, folder), gone))


@query("group_list", "SELECT DISTINCT 'profile' AS feature_group FROM customer UNION SELECT DISTINCT 'orders' FROM orders")
def group_list(spark, folder):
    return S.group_list(store(spark, folder))


@query(
    "entities_listing",
    with_(
        STORE,
        """SELECT p.entity_id, CAST(3 + coalesce(CASE WHEN o.has_early THEN 3 WHEN o.entity_id IS NOT NULL THEN 2 END, 0) AS BIGINT) AS feature_count,
             greatest(p.ingested, coalesce(o.ingested, p.ingested)) AS last_update
           FROM profile p LEFT JOIN order_store o ON o.entity_id = p.entity_id ORDER BY p.entity_id LIMIT 100""",
    ),
)
def entities_listing(spark, folder):
    """First hundred entities in order: the limit is the feature."""
    return S.entity_listing(store(spark, folder), 100)


@query(
    "store_summary",
    with_(
        STORE,
        """SELECT feature_group, count(DISTINCT entity_id) AS entities, CAST(sum(names) AS BIGINT) AS features FROM (
             SELECT feature_group, entity_id, 3 AS names FROM profile
             UNION ALL SELECT feature_group, entity_id, CASE WHEN has_early THEN 3 ELSE 2 END FROM order_store) GROUP BY feature_group
           UNION ALL SELECT 'TOTAL', count(DISTINCT entity_id), CAST(sum(names) AS BIGINT) FROM (
             SELECT entity_id, 3 AS names FROM profile
             UNION ALL SELECT entity_id, CASE WHEN has_early THEN 3 ELSE 2 END FROM order_store)""",
    ),
)
def store_summary(spark, folder):
    return S.store_summary(store(spark, folder))


@query(
    "src_feature_store",
    with_(STORE, f"SELECT entity_id AS user_id, {r7('acctbal')} AS acctbal, segment, CAST(nation AS DOUBLE) AS nation FROM profile"),
)
def src_feature_store(spark, folder):
    """Active rows of a group as wide columns, no pivot."""
    return S.wide_features(store(spark, folder), "profile", ["acctbal", "segment", "nation"], numeric=["acctbal", "nation"])


@query(
    "fs_snapshots",
    with_(
        STORE,
        f"SELECT entity_id, {r7('acctbal')} AS acctbal, segment, CAST(1 AS BIGINT) AS repeats FROM profile",
    ),
)
def fs_snapshots(spark, folder):
    """The stored table: two batches, the second delivered twice."""
    first, second = profile_batches(spark, folder)
    path = work_path(spark, "store")
    stored = S.FeatureTable(spark, path)
    stored.upsert(S.pack_features(first, "profile", processing_time=EARLY), 1)
    for _ in range(2):
        stored.upsert(S.pack_features(second, "profile", processing_time=LATE), 2)
    return stored.read().select(
        "entity_id",
        value("acctbal").try_cast("double").alias("acctbal"),
        value("segment").alias("segment"),
        F.lit(1).alias("repeats"),
    )
