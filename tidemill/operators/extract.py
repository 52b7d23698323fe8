"""Feature extraction from raw transaction records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import record as R
from tidemill.functions.payload import MAP, JsonRecord, TableRecord

#: Characters of a failed record that its error row keeps unless told otherwise.
ELEMENT_CHARS = 1000
ERROR = "extraction_error"
ELEMENT = "extraction_element"


def moment(value: Column | dt.datetime | str | None) -> Column:
    """Processing time as a timestamp column; the current time when not given."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def _wall_text(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


NUMBERS = {"amount": "double", **R.NUMERICAL_FIELDS}


def read_document(df: DataFrame, document: str, fields: str = "_fields") -> tuple[DataFrame, JsonRecord]:
    """Add the map of a JSON text or VARIANT column and a reader for it."""
    if dict(df.dtypes)[document] == "string":
        variant, entries = f"try_parse_json(`{document}`)", f"from_json(`{document}`, '{MAP}')"
    else:
        variant, entries = f"`{document}`", f"try_variant_get(`{document}`, '$', '{MAP}')"
    return df.selectExpr("*", f"{entries} AS {fields}"), JsonRecord(fields, variant)


def _json_envelope(df: DataFrame, document: str) -> tuple[DataFrame, JsonRecord]:
    """Split an element into its envelope and the payload inside ``data``."""
    shown = f"`{document}`" if dict(df.dtypes)[document] == "string" else f"to_json(`{document}`)"
    df, outer = read_document(df, document, "_element")
    wrapped = outer.present("data")
    df = df.selectExpr(
        "*",
        f"{shown} AS _shown",
        f"IF({wrapped}, from_json({outer.text('data')}, '{MAP}'), _element) AS _fields",
        f"{outer.text_or('message_id', 'unknown')} AS _message_id",
        f"{outer.text('timestamp')} AS _stamp",
        # Text that is not a time counts as missing; other values are failures.
        f"CASE WHEN {outer.is_null('timestamp')} OR ({R.wall_clock(outer.text('timestamp'))} IS NULL "
        f"AND {outer.present('timestamp')} AND {outer.kind('timestamp')} <> 'STRING') THEN 'timestamp is not text' "
        f"WHEN {wrapped} AND coalesce({outer.text('data')} NOT LIKE '{{%', TRUE) "
        "THEN 'data is not an object' END AS _envelope_error",
    )
    node = f"IF({wrapped}, try_variant_get({outer.document}, '$.data', 'variant'), {outer.document})"
    record = JsonRecord("_fields", node)
    return record.stage(df, NUMBERS), record


def _table_envelope(df: DataFrame) -> tuple[DataFrame, TableRecord]:
    record = TableRecord(df, NUMBERS)
    typed = record.types.get("timestamp", "string") != "string"
    payload = ", ".join(f"`{c}`" for c in df.columns if not c.startswith("_"))
    df = df.selectExpr(
        "*",
        f"to_json(struct({payload})) AS _shown",
        f"{record.text_or('message_id', 'unknown')} AS _message_id",
        "CAST(timestamp AS TIMESTAMP_NTZ) AS _stamp" if typed else f"{record.text('timestamp')} AS _stamp",
        "CAST(NULL AS STRING) AS _envelope_error",
    )
    return df, record


def fence(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows with some columns generated from themselves.

    Spark moves a filter on a plain column below the projections that make it,
    which would parse times and numbers once more per filter. It does not move
    filters on generated columns. The generator only packs finished columns,
    because it does not take part in code generation.
    """
    packed = ", ".join(f"`{name}`" for name in columns)
    others = [f"`{name}`" for name in df.columns if name not in columns]
    return df.selectExpr(*others, f"inline(array(struct({packed})))")


def extract_features(
    df: DataFrame,
    document: str | None = None,
    processing_time: Column | dt.datetime | str | None = None,
    domain: str = "transaction",
    keep: tuple[str, ...] = (),
    max_chars: int | None = R.MAX_TEXT,
    element_chars: int | None = ELEMENT_CHARS,
) -> DataFrame:
    """One row of features per record, with the failure beside it.

    ``document`` names a JSON text or VARIANT column; without it the frame's
    own columns are the payload. Rows that cannot be read carry a message in
    ``extraction_error``; split them with :func:`features_of` and
    :func:`errors_of` instead of extracting twice.

    Any domain but ``generic`` uses the transaction fields. ``keep`` passes
    columns of the input through unchanged. Texts are cut to ``max_chars`` and
    failed records to ``element_chars`` characters; None keeps them whole.
    """
    generic = generic_names(df) if document is None else None
    df, record = _table_envelope(df) if document is None else _json_envelope(df, document)
    # A typed time needs no parsing and has no offset of its own.
    typed = dict(df.dtypes)["_stamp"] != "string"
    base = (
        df.withColumn("_now", moment(processing_time))
        .selectExpr(
            "*",
            f"{'_stamp' if typed else R.wall_clock('_stamp')} AS _parsed",
            "'' AS _given" if typed else f"{R.utc_offset('_stamp')} AS _given",
            *R.aliased(R.amount_stage(record)),
        )
        .selectExpr(
            "*",
            "coalesce(_parsed, CAST(_now AS TIMESTAMP_NTZ)) AS _wall",
            "IF(_parsed IS NULL, '+00:00', _given) AS _offset",
        )
        .selectExpr("*", f"{R.instant('_wall', '_offset')} AS _instant")
    )

    base = base.selectExpr("*", f"coalesce(_envelope_error, {R.numerical_error(record)}) AS _error")
    if document is not None:
        staged = [f"_number_{name}" for name in NUMBERS]
        base = fence(base, ["_error", "_amount", "_amount_broken", "_wall", "_offset", "_instant", *staged])

    columns: dict[str, str] = {}
    if domain == "generic":
        columns.update(generic_columns(generic, getattr(record, "document", None)))
    else:
        columns.update(R.amount_columns())
        columns.update(R.entity_columns(record))
    columns.update(R.temporal_columns("_wall", "_instant"))
    columns.update(R.categorical_columns(record))
    columns.update(R.numerical_columns(record))

    reserved = {"message_id", "timestamp", "processed_at", "event_time", "event_wall", ERROR, ELEMENT, *keep}
    columns = {name: expression for name, expression in columns.items() if name not in reserved}
    has_amount = "amount" in columns
    if not has_amount:
        columns["amount"] = "0.0D"
    outputs = [
        "_message_id AS message_id",
        f"{R.iso_text('_wall', '_offset')} AS timestamp",
        "date_format(_now, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS processed_at",
        "_instant AS event_time",
        "_wall AS event_wall",
        *R.aliased(columns),
        f"_error AS {ERROR}",
        f"_shown AS {ELEMENT}",
    ]
    first = base.selectExpr(*[f"`{name}`" for name in keep], *outputs)
    derived = first.selectExpr("*", *R.aliased(R.derived_columns()))
    fixed = {"event_time", "event_wall", ERROR, *keep}
    result = []
    for name, kind in derived.dtypes:
        if name == ELEMENT:
            element = ELEMENT if element_chars is None else f"substr({ELEMENT}, 1, {element_chars})"
            result.append(f"IF({ERROR} IS NOT NULL, {element}, NULL) AS {ELEMENT}")
        elif name in fixed:
            result.append(f"`{name}`")
        elif has_amount or name != "amount":
            result.append(f"{R.clean(name, kind, max_chars)} AS `{name}`")
    return derived.selectExpr(*result)


# The scalar types that the generic domain passes through.
_ATOMIC = ("string", "boolean", "double", "float", "bigint", "int", "smallint", "tinyint")


def generic_names(df: DataFrame) -> list[str]:
    """Scalar columns of a table."""
    return [n for n, kind in df.dtypes if kind.split("(")[0] in _ATOMIC and not n.startswith("_")]


def generic_columns(names: list[str] | None, document: str | None = None) -> dict[str, str]:
    """Top-level numbers, strings and booleans; nested values are dropped.

    A table knows its scalar columns. A JSON document has an open set of keys,
    so its scalars go into one map of text.
    """
    if names is not None:
        return {name: f"`{name}`" for name in names}
    members = f"map_entries(try_variant_get({document}, '$', 'map<string,variant>'))"
    scalar = "e -> schema_of_variant(e.value) NOT RLIKE '^(OBJECT|ARRAY)'"
    text = "e -> struct(e.key, try_variant_get(e.value, '$', 'string') AS value)"
    return {"fields": f"map_from_entries(transform(filter({members}, {scalar}), {text}))"}


def features_of(extracted: DataFrame) -> DataFrame:
    """Rows that were read without a failure."""
    return extracted.filter(F.col(ERROR).isNull()).drop(ERROR, ELEMENT)


def errors_of(
    extracted: DataFrame,
    processing_time: Column | dt.datetime | str | None = None,
    transform: str = "FeatureExtraction",
) -> DataFrame:
    """Failed records as error rows."""
    return extracted.filter(F.col(ERROR).isNotNull()).select(
        F.col(ERROR).alias("error"),
        F.col(ELEMENT).alias("element"),
        F.lit(transform).alias("transform"),
        _wall_text(moment(processing_time)).alias("timestamp"),
    )


def dead_letters(
    df: DataFrame,
    key: str,
    processing_time: Column | dt.datetime | str | None = None,
    transform: str = "WriteToFeatureStore",
    max_chars: int = 500,
) -> DataFrame:
    """Rows that have no usable entity key, in error form."""
    return df.filter(F.col(key).isNull() | (F.col(key) == "unknown")).select(
        F.lit(f"Missing or unknown {key}").alias("error"),
        F.substring(F.to_json(F.struct(*df.columns)), 1, max_chars).alias("element"),
        F.lit(transform).alias("transform"),
        _wall_text(moment(processing_time)).alias("timestamp"),
    )
