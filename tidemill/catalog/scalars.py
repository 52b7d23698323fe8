"""Encodings, store transforms and notebook scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.records import codes_sql
from tidemill.catalog.registry import (
    EV,
    FEAT,
    LABELLED,
    crc_values,
    features,
    query,
    r7,
    with_,
)
from tidemill.catalog.aggregates import labelled
from tidemill.config import FRAUD_DETECTOR, Mapping
from tidemill.functions import scalars as S
from tidemill.functions import transforms as T
from tidemill.operators.explore import frequent_categories, label_codes
from tidemill.operators import explore as E
from tidemill.operators.mapping import fill_nulls_zero, has_model_schema, transform_features
from tidemill.session import table
from tidemill.sources.adapters import with_k


@query(
    "hash_encode",
    with_(
        f"{FEAT}, {codes_sql()}",
        """SELECT message_id, CAST(m.b AS BIGINT) AS merchant_code, CAST(p.b AS BIGINT) AS payment_code
           FROM feat JOIN merchant_codes m ON m.n = merchant_category JOIN payment_codes p ON p.n = payment_method""",
    ),
)
def hash_encode(spark, folder):
    """CRC-32 buckets, checked against zlib."""
    return features(spark, folder).select(
        "message_id",
        S.hash_encode(F.col("merchant_category"), 100).alias("merchant_code"),
        S.hash_encode(F.col("payment_method"), 10).alias("payment_code"),
    )


WORDS = ("true", "TRUE", "Yes", "1", "no", "0", "", "maybe", "on")


def mixed_values(spark, folder):
    """One text, number and boolean per event, with nulls."""
    k = F.col("k")
    words = F.array(*[F.lit(w) for w in WORDS], F.lit(None).cast("string"))
    return with_k(table(spark, folder, "events")).select(
        "event_id",
        F.element_at(words, k % 10 + 1).alias("word"),
        F.when(k % 7 != 0, k % 3).alias("number"),
        F.when(k % 5 != 0, k % 2 == 0).alias("flag"),
    )


MIXED = f"""{EV}, mixed AS (SELECT event_id, list_extract({[*WORDS]!r}::VARCHAR[], CAST(k % 10 + 1 AS INTEGER)) AS word,
  CASE WHEN k % 7 <> 0 THEN k % 3 END AS number, CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS flag FROM ev)"""


@query(
    "bool_to_int",
    with_(
        MIXED,
        """SELECT event_id, CAST(CASE WHEN lower(word) IN ('true', '1', 'yes') THEN 1 ELSE 0 END AS BIGINT) AS word,
             CAST(CASE WHEN number <> 0 THEN 1 ELSE 0 END AS BIGINT) AS number,
             CAST(CASE WHEN flag THEN 1 ELSE 0 END AS BIGINT) AS flag FROM mixed""",
    ),
)
def bool_to_int(spark, folder):
    df = mixed_values(spark, folder)
    kinds = dict(df.dtypes)
    return df.select("event_id", *[S.bool_to_int(F.col(c), kinds[c]).alias(c) for c in ("word", "number", "flag")])


@query(
    "coerce_numeric",
    with_(
        MIXED,
        """SELECT event_id, CASE WHEN word = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS word,
             CAST(coalesce(number, 0) AS BIGINT) AS number, CAST(CASE WHEN flag THEN 1 ELSE 0 END AS BIGINT) AS flag FROM mixed""",
    ),
)
def coerce_numeric(spark, folder):
    df = mixed_values(spark, folder)
    kinds = dict(df.dtypes)
    return df.select("event_id", *[S.coerce_numeric(F.col(c), kinds[c]).alias(c) for c in ("word", "number", "flag")])


@query(
    "apply_transform",
    with_(
        f"{MIXED}, codes(n, b) AS (VALUES {crc_values(WORDS, 50)}), flags(n, b) AS (VALUES {crc_values(('True', 'False'), 50)})",
        """SELECT event_id, CAST(coalesce(c.b, 0) AS BIGINT) AS hashed_word, CAST(coalesce(f.b, 0) AS BIGINT) AS hashed_flag,
             CAST(CASE WHEN number <> 0 THEN 1 ELSE 0 END AS BIGINT) AS truth, CAST(0 AS BIGINT) AS unknown
           FROM mixed LEFT JOIN codes c ON c.n = word
             LEFT JOIN flags f ON f.n = CASE WHEN flag THEN 'True' WHEN NOT flag THEN 'False' END""",
    ),
)
def apply_transform(spark, folder):
    """Null hashes to 0, booleans hash as Python prints them, unknown kinds give 0."""
    df = mixed_values(spark, folder)
    return df.select(
        "event_id",
        S.apply_transform(Mapping("word", "hash_encode", 50), F.col("word"), "string").alias("hashed_word"),
        S.apply_transform(Mapping("flag", "hash_encode", 50), F.col("flag"), "boolean").alias("hashed_flag"),
        S.apply_transform(Mapping("number", "bool_to_int"), F.col("number"), "int").alias("truth"),
        S.apply_transform(Mapping("number", "no_such_kind"), F.col("number"), "int").alias("unknown"),
    )


MODEL_COLUMNS = """CAST(hour_of_day AS BIGINT) AS hour_of_day, CAST(day_of_week AS BIGINT) AS day_of_week,
  CAST(CASE WHEN is_weekend THEN 1 ELSE 0 END AS BIGINT) AS is_weekend"""


@query(
    "transform_features",
    with_(
        f"{FEAT}, {codes_sql()}",
        f"""SELECT message_id, {MODEL_COLUMNS}, CAST(0 AS BIGINT) AS transaction_count_24h, CAST(0 AS BIGINT) AS avg_amount_30d,
             {r7('amount')} AS amount, CAST(m.b AS BIGINT) AS merchant_category_encoded, CAST(p.b AS BIGINT) AS payment_method_encoded
           FROM feat JOIN merchant_codes m ON m.n = merchant_category JOIN payment_codes p ON p.n = payment_method""",
    ),
)
def transform_model(spark, folder):
    """Ordered model columns; aggregate columns are absent here and become 0."""
    return transform_features(features(spark, folder), FRAUD_DETECTOR, ("message_id",))


@query(
    "schema_match_skip",
    with_(
        FEAT,
        f"""SELECT message_id, {MODEL_COLUMNS}, CAST(7 AS BIGINT) AS transaction_count_24h, 1.5::DOUBLE AS avg_amount_30d,
             {r7('amount')} AS amount, CAST(3 AS BIGINT) AS merchant_category_encoded, CAST(4 AS BIGINT) AS payment_method_encoded,
             TRUE AS skipped FROM feat""",
    ),
)
def schema_match_skip(spark, folder):
    """A frame that has all model columns already is not mapped again."""
    ready = features(spark, folder).select(
        "message_id",
        "hour_of_day",
        "day_of_week",
        F.col("is_weekend").cast("int").alias("is_weekend"),
        F.lit(7).alias("transaction_count_24h"),
        F.lit(1.5).alias("avg_amount_30d"),
        "amount",
        F.lit(3).alias("merchant_category_encoded"),
        F.lit(4).alias("payment_method_encoded"),
    )
    mapped = transform_features(ready, FRAUD_DETECTOR, ("message_id",), skip_if_mapped=True)
    return mapped.withColumn("skipped", F.lit(has_model_schema(ready, FRAUD_DETECTOR)))


@query(
    "fill_nulls_zero",
    with_(MIXED, "SELECT event_id, CAST(coalesce(number, 0) AS BIGINT) AS number FROM mixed"),
)
def fill_zero(spark, folder):
    return fill_nulls_zero(mixed_values(spark, folder).select("event_id", "number"))


# Texts with every irregularity, by k: blanks, bad numbers, padding.
TEXT_SQL = f"""{EV}, texts AS (SELECT event_id, k, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
    WHEN 3 THEN 'not_a_number' WHEN 4 THEN ' ' || CAST(k AS VARCHAR) || ' ' WHEN 5 THEN '-' || CAST(k AS VARCHAR)
    WHEN 6 THEN '1' || CAST(k AS VARCHAR) || '.5' ELSE CAST(k AS VARCHAR) END AS v FROM ev)"""


def texts(spark, folder):
    k = F.col("k")
    text = k.cast("string")
    return with_k(table(spark, folder, "events")).select(
        "event_id",
        "k",
        F.when(k % 10 == 0, F.lit(None))
        .when(k % 10 == 1, "")
        .when(k % 10 == 2, "   ")
        .when(k % 10 == 3, "not_a_number")
        .when(k % 10 == 4, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(k % 10 == 5, F.concat(F.lit("-"), text))
        .when(k % 10 == 6, F.concat(F.lit("1"), text, F.lit(".5")))
        .otherwise(text)
        .alias("v"),
    )


@query(
    "t_numeric",
    with_(
        TEXT_SQL,
        f"""SELECT event_id,
             CASE WHEN k % 10 IN (0, 1, 2) THEN 0.3::DOUBLE WHEN k % 10 = 3 THEN 30.0::DOUBLE
               ELSE {r7('(least(greatest(CAST(trim(v) AS DOUBLE), 0), 100)) / 100')} END AS scaled,
             CASE WHEN k % 10 IN (0, 1, 2, 3) THEN NULL ELSE {r7('CAST(trim(v) AS DOUBLE)')} END AS raw
           FROM (SELECT event_id, k, CASE WHEN k % 10 < 4 THEN '0' ELSE v END AS v FROM texts)""",
    ),
)
def t_numeric(spark, folder):
    """Default 30 is clipped and scaled for missing text, but not for broken text."""
    scaled = T.Numeric(0, 100, normalize=True, default=30.0)
    raw = T.Numeric(clip=False, fill=False)
    return texts(spark, folder).select(
        "event_id", scaled(F.col("v"), "string").alias("scaled"), raw(F.col("v"), "string").alias("raw")
    )


COLORS = ("red", " GREEN ", "Blue", "yellow", "", None)
COLOR_SQL = f"""{EV}, colors AS (SELECT event_id, CASE k % 6 WHEN 0 THEN 'red' WHEN 1 THEN ' GREEN ' WHEN 2 THEN 'Blue'
  WHEN 3 THEN 'yellow' WHEN 4 THEN '' END AS v FROM ev)"""


@query(
    "t_categorical",
    with_(
        COLOR_SQL,
        """SELECT event_id, CASE trim(lower(v)) WHEN 'red' THEN 'red' WHEN 'green' THEN 'green' WHEN 'blue' THEN 'blue' ELSE 'unknown' END AS category,
             CAST(CASE trim(lower(v)) WHEN 'red' THEN 0 WHEN 'green' THEN 1 WHEN 'blue' THEN 2 ELSE 3 END AS BIGINT) AS code,
             CASE WHEN trim(lower(v)) IN ('red', 'green', 'blue') THEN trim(lower(v)) END AS strict
           FROM colors""",
    ),
)
def t_categorical(spark, folder):
    values = F.array(*[F.lit(c).cast("string") for c in COLORS])
    df = with_k(table(spark, folder, "events")).select("event_id", F.element_at(values, F.col("k") % 6 + 1).alias("v"))
    valid = ("red", "Green", "blue")
    return df.select(
        "event_id",
        T.Categorical(valid)(F.col("v"), "string").alias("category"),
        T.Categorical(valid, encode=True)(F.col("v"), "string").alias("code"),
        T.Categorical(valid, fill=False)(F.col("v"), "string").alias("strict"),
    )


@query(
    "t_datetime",
    with_(
        EV,
        """SELECT event_id, CASE WHEN k % 6 = 5 THEN NULL ELSE CAST(epoch(t) AS DOUBLE) END AS epoch_seconds,
             CASE WHEN k % 6 = 5 THEN NULL ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') END AS iso,
             CASE WHEN k % 6 = 5 THEN NULL ELSE CAST(isodow(t) - 1 AS BIGINT) END AS weekday,
             CASE WHEN k % 6 = 5 THEN NULL ELSE CAST(dayofyear(t) AS BIGINT) END AS day_of_year,
             CASE WHEN k % 6 = 5 THEN NULL ELSE CAST(hour(t) AS BIGINT) END AS hour
           FROM (SELECT event_id, k, CASE WHEN k % 6 IN (0, 1) THEN date_trunc('second', ts)
               WHEN k % 6 = 4 AND day(ts) <= 12 THEN make_timestamp(2024, day(ts), month(ts), 0, 0, 0.0)
               ELSE date_trunc('day', ts) END AS t FROM ev)""",
    ),
)
def t_datetime(spark, folder):
    """Five formats; day-first dates with a day up to 12 read as month first."""
    k, ts = F.col("k"), F.col("ts")
    formats = (
        "yyyy-MM-dd HH:mm:ss",
        "yyyy-MM-dd'T'HH:mm:ss",
        "yyyy-MM-dd",
        "MM/dd/yyyy",
        "dd/MM/yyyy",
    )
    text = F.lit("no date")
    for i, pattern in enumerate(formats):
        text = F.when(k % 6 == i, F.date_format(ts, pattern)).otherwise(text)
    df = with_k(table(spark, folder, "events")).select("event_id", text.alias("v"))
    parts = T.DateTime("components")(F.col("v"), "string")
    return df.select(
        "event_id",
        T.DateTime()(F.col("v"), "string").alias("epoch_seconds"),
        T.DateTime("iso")(F.col("v"), "string").alias("iso"),
        parts["weekday"].alias("weekday"),
        parts["day_of_year"].alias("day_of_year"),
        parts["hour"].alias("hour"),
    )


@query(
    "t_boolean",
    with_(
        MIXED,
        """SELECT event_id, word IS NOT NULL AND word <> '' AND lower(word) NOT IN ('no', '0') AS word,
             CAST(CASE WHEN number <> 0 THEN 1 ELSE 0 END AS BIGINT) AS number, flag FROM mixed""",
    ),
)
def t_boolean(spark, folder):
    """Any other non-blank text is true."""
    df = mixed_values(spark, folder)
    return df.select(
        "event_id",
        T.Boolean()(F.col("word"), "string").alias("word"),
        T.Boolean(numeric=True)(F.col("number"), "int").alias("number"),
        T.Boolean(fill=False)(F.col("flag"), "boolean").alias("flag"),
    )


CLEAN_TEXT = r"regexp_replace(lower(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')), '[^a-zA-Z0-9\s]', '', 'g')"


@query(
    "t_text",
    f"SELECT doc_id, {CLEAN_TEXT} AS text FROM documents",
)
def t_text(spark, folder):
    """Whole documents: strip, fold, drop special characters."""
    clean = T.Text(plain=True)
    return table(spark, folder, "documents").select("doc_id", clean(F.col("text"), "string").alias("text"))


@query("t_text_cut", f"SELECT doc_id, substr({CLEAN_TEXT}, 1, 200) AS text FROM documents")
def t_text_cut(spark, folder):
    """Cutting to a length is the last step of the transform."""
    clean = T.Text(max_length=200, plain=True)
    return table(spark, folder, "documents").select("doc_id", clean(F.col("text"), "string").alias("text"))


PRESET_SQL = f"""SELECT message_id, {r7('least(greatest(amount, 0), 10000)')} AS amount,
  CASE WHEN merchant_category IN ('electronics', 'grocery', 'restaurant') THEN merchant_category ELSE 'other' END AS merchant_category,
  'credit' AS payment_method, channel FROM feat"""


@query("t_registry", with_(FEAT, f"SELECT message_id, channel, upper(channel) AS shout, {r7('amount / 5000')} AS amount FROM feat"))
def t_registry(spark, folder):
    """Own transforms by feature name; unregistered features pass through."""
    registry = T.TransformRegistry()
    registry.register("shout", lambda column, kind: F.upper(column))
    registry.register("amount", T.Numeric(0, 5000, normalize=True))
    rows = features(spark, folder).select("message_id", "channel", F.col("channel").alias("shout"), "amount")
    return registry.apply(rows)


@query("t_common_preset", with_(FEAT, PRESET_SQL))
def t_common_preset(spark, folder):
    rows = features(spark, folder).select("message_id", "amount", "merchant_category", "payment_method", "channel")
    return T.common_transforms().apply(rows)


@query("s_log1p", with_(FEAT, f"SELECT message_id, {r7('ln(1 + amount)')} AS amount_log FROM feat"))
def s_log1p(spark, folder):
    return features(spark, folder).select("message_id", F.log1p("amount").alias("amount_log"))


@query("s_interaction", with_(FEAT, f"SELECT message_id, {r7('risk_score * amount')} AS risk_amount FROM feat"))
def s_interaction(spark, folder):
    return features(spark, folder).select(
        "message_id", S.interaction(F.col("risk_score"), F.col("amount")).alias("risk_amount")
    )


@query(
    "s_unusual_hour",
    with_(FEAT, "SELECT message_id, CAST(CASE WHEN hour_of_day < 6 OR hour_of_day > 22 THEN 1 ELSE 0 END AS BIGINT) AS unusual_hour FROM feat"),
)
def s_unusual_hour(spark, folder):
    return features(spark, folder).select("message_id", S.unusual_hour(F.col("hour_of_day")).alias("unusual_hour"))


@query(
    "s_label_encode",
    """SELECT o_orderkey, CAST(r.code AS DOUBLE) AS code FROM orders JOIN (
         SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) r ON r.p = o_orderpriority""",
)
def s_label_encode(spark, folder):
    encoded = label_codes(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return encoded.select("o_orderkey", F.col("o_orderpriority_code").alias("code"))


@query(
    "s_onehot",
    """SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS BIGINT) AS building,
         CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS BIGINT) AS machinery FROM customer""",
)
def s_onehot(spark, folder):
    """Two known categories; all other segments are zero everywhere."""
    columns = S.one_hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])
    return table(spark, folder, "customer").select("c_custkey", *[c.alias(n.lower()) for n, c in columns.items()])


FITTED_SQL = ", ".join(
    f"CAST(count(*) FILTER (WHERE source = (SELECT source FROM top WHERE place = {i})) AS BIGINT) AS top_{i}" for i in range(1, 4)
)


@query(
    "s_onehot_fitted",
    f"""WITH top AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents WHERE source IS NOT NULL GROUP BY source)
        SELECT lang, {FITTED_SQL} FROM documents GROUP BY lang""",
)
def s_onehot_fitted(spark, folder):
    """The three most frequent sources as columns, counted per language."""
    docs = table(spark, folder, "documents").select("lang", "source")
    columns = S.one_hot(F.col("source"), frequent_categories(docs, "source", 3))
    coded = docs.select("lang", *[c.alias(f"top_{i}") for i, c in enumerate(columns.values(), 1)])
    return coded.groupBy("lang").agg(*[F.sum(f"top_{i}").alias(f"top_{i}") for i in range(1, len(columns) + 1)])


@query(
    "s_age_bucket",
    with_(
        EV,
        """SELECT event_id, CAST(CASE WHEN a < 18 THEN 0 WHEN a < 25 THEN 1 WHEN a < 35 THEN 2 WHEN a < 45 THEN 3
             WHEN a < 55 THEN 4 WHEN a < 65 THEN 5 WHEN a < 100 THEN 6 ELSE 7 END AS BIGINT) AS age_bucket
           FROM (SELECT event_id, k + 5 AS a FROM ev)""",
    ),
)
def s_age_bucket(spark, folder):
    return with_k(table(spark, folder, "events")).select("event_id", S.age_bucket(F.col("k") + 5).alias("age_bucket"))


@query(
    "s_ordinal",
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
         WHEN '2-HIGH' THEN 3 ELSE -1 END AS BIGINT) AS level FROM orders""",
)
def s_ordinal(spark, folder):
    levels = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH")
    return table(spark, folder, "orders").select(
        "o_orderkey", S.ordinal_code(F.col("o_orderpriority"), levels).alias("level")
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PLACES = crc_values([f"{s}_N{n}" for s in SEGMENTS for n in range(25)], 1000)


@query(
    "s_location_hash",
    f"""WITH codes(n, b) AS (VALUES {_PLACES})
       SELECT c_custkey, CAST(b AS BIGINT) AS location_hash FROM customer JOIN codes ON n = c_mktsegment || '_N' || c_nationkey""",
)
def s_location_hash(spark, folder):
    state = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    return table(spark, folder, "customer").select(
        "c_custkey", S.location_hash(F.col("c_mktsegment"), state).alias("location_hash")
    )


@query(
    "s_location_risk",
    with_(
        LABELLED,
        f"""SELECT channel, merchant_category, count(*) AS "rows",
             {r7('(sum(label) + 20 * (SELECT avg(label) FROM labelled)) / (count(*) + 20)')} AS location_risk_score
           FROM labelled GROUP BY channel, merchant_category""",
    ),
)
def s_location_risk(spark, folder):
    return E.smoothed_risk(labelled(spark, folder), ["channel", "merchant_category"])


@query(
    "s_payment_code",
    with_(
        EV,
        "SELECT event_id, CAST(CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS payment_code FROM ev",
    ),
)
def s_payment_code(spark, folder):
    names = F.array(*[F.lit(n) for n in ("credit", "debit", "cash", "voucher")])
    method = F.element_at(names, F.col("k") % 4 + 1)
    return with_k(table(spark, folder, "events")).select(
        "event_id", S.literal_code(method, S.PAYMENT_CODES).alias("payment_code")
    )
