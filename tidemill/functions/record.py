"""Per-record feature columns as SQL expressions.

Each builder returns ``{name: expression}``; ``operators.extract`` puts them
together in a few projections that run inside the scan's stage.
"""

from __future__ import annotations

from tidemill.functions.payload import WHITESPACE, JsonRecord, TableRecord

Record = JsonRecord | TableRecord

# Text fields and the value used when the key is missing.
ENTITY_FIELDS = {
    "merchant_category": "unknown",
    "merchant_id": "unknown",
    "merchant_name": "unknown",
    "user_id": "unknown",
    "account_id": "unknown",
    "transaction_type": "unknown",
    "payment_method": "unknown",
    "currency": "USD",
}
CATEGORICAL_FIELDS = (
    "country",
    "state",
    "city",
    "zip_code",
    "device_type",
    "os_type",
    "browser",
    "channel",
    "source",
)
# Numeric fields in the order in which they are checked.
NUMERICAL_FIELDS = {
    "risk_score": "double",
    "fraud_score": "double",
    "credit_score": "double",
    "account_age_days": "bigint",
    "transaction_count": "bigint",
    "account_balance": "double",
    "latitude": "double",
    "longitude": "double",
}
# Upper bounds of the amount categories; above the last is "huge".
AMOUNT_BANDS = (("micro", 10.0), ("small", 100.0), ("medium", 1000.0), ("large", 10000.0))
HIGH_AMOUNT = 500.0
#: Characters of a text that a record keeps unless told otherwise.
MAX_TEXT = 100

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?)?$"
)


def wall_clock(text: str) -> str:
    """Local date and time as written, without the offset; null if not ISO."""
    # Dates have no offset to cut. A bare hour gets the minutes Spark needs.
    bare = f"replace(IF(length({text}) > 10, regexp_replace({text}, r'{_OFFSET}', ''), {text}), ',', '.')"
    whole = f"regexp_replace({bare}, r'^(.{{13}})$', '$1:00')"
    return f"CASE WHEN {text} RLIKE r'{_ISO}' THEN try_cast({whole} AS TIMESTAMP_NTZ) END"


def utc_offset(text: str) -> str:
    """Offset as ``+HH:MM``; ``Z`` reads as ``+00:00`` and none as empty text."""
    found = f"IF(length({text}) > 10, regexp_extract({text}, r'{_OFFSET}', 1), '')"
    return rf"regexp_replace(replace({found}, 'Z', '+00:00'), r'^(...)(\d\d)$', '$1:$2')"


def instant(wall: str, offset: str) -> str:
    """The moment in time; a wall clock without offset counts as UTC."""
    minutes = (
        f"coalesce(try_cast(substr({offset}, 2, 2) AS INT) * 60 + try_cast(substr({offset}, 5, 2) AS INT), 0)"
    )
    shift = f"make_dt_interval(0, 0, IF({offset} LIKE '-%', -1, 1) * {minutes})"
    # Interval arithmetic from the epoch does not depend on the session's zone.
    since = f"({wall} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return f"TIMESTAMP'1970-01-01 00:00:00Z' + {since} - IF({offset} = '', INTERVAL '0' SECOND, {shift})"


def iso_text(wall: str, offset: str) -> str:
    """ISO text with microseconds only when there are some."""
    stamp = f"date_format({wall}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    return f"concat(replace({stamp}, '.000000', ''), {offset})"


def amount_category(amount: str) -> str:
    """Band of an amount; negative amounts fall into the lowest band."""
    tests = " ".join(f"WHEN {amount} < {upper} THEN '{name}'" for name, upper in AMOUNT_BANDS)
    return f"CASE WHEN {amount} IS NULL THEN NULL {tests} ELSE 'huge' END"


def amount_stage(record: Record, name: str = "amount") -> dict[str, str]:
    """Amount as read, and with 0 for text that is no number.

    Missing key: 0 in both. Null: null in both. Not a number: null as read.
    """
    known = f"IF({record.present(name)}, {record.number(name)}, 0.0D)"
    broken = f"{record.present(name)} AND NOT {record.is_null(name)} AND {record.number(name)} IS NULL"
    return {"_amount": known, "_amount_broken": broken}


def amount_columns() -> dict[str, str]:
    """Amount and its derivatives from the staged amount.

    Null: every column null. Not a number: zeros, and no rounded value and no
    category.
    """
    filled = "IF(_amount_broken, 0.0D, _amount)"
    return {
        "amount": filled,
        "amount_log": f"CASE WHEN {filled} > 0 THEN ln(1 + {filled}) WHEN {filled} <= 0 THEN 0.0D END",
        "is_high_amount": f"{filled} > {HIGH_AMOUNT}",
        "amount_rounded": "bround(_amount, 2)",
        "amount_category": amount_category("_amount"),
    }


def entity_columns(record: Record) -> dict[str, str]:
    """Merchant, user and transaction identifiers."""
    return {name: record.text_or(name, default) for name, default in ENTITY_FIELDS.items()}


def categorical_columns(record: Record) -> dict[str, str]:
    """Location, device and channel, read from the top level only."""
    return {name: record.text_or(name, "unknown") for name in CATEGORICAL_FIELDS}


def numerical_columns(record: Record) -> dict[str, str]:
    """Scores, account facts and coordinates; 0 when the key is missing."""
    return {
        name: f"IF({record.present(name)}, {record.number(name)}, CAST(0 AS {kind}))"
        for name, kind in NUMERICAL_FIELDS.items()
    }


# What Python says about values it cannot read as numbers.
NULL_MESSAGES = {
    "double": "float() argument must be a string or a real number, not 'NoneType'",
    "bigint": "int() argument must be a string, a bytes-like object or a real number, not 'NoneType'",
}
TEXT_MESSAGES = {
    "double": "could not convert string to float: '",
    "bigint": "invalid literal for int() with base 10: '",
}


def numerical_error(record: Record) -> str:
    """Message for the first numeric field that is null or unreadable."""
    tests = []
    for name, kind in NUMERICAL_FIELDS.items():
        if record.present(name) == "FALSE":
            continue
        tests.append(f'WHEN {record.present(name)} AND {record.is_null(name)} THEN "{NULL_MESSAGES[kind]}"')
        tests.append(
            f"WHEN {record.present(name)} AND {record.number(name)} IS NULL "
            f'THEN concat("{TEXT_MESSAGES[kind]}", {record.text(name)}, "\'")'
        )
    return f"CASE {' '.join(tests)} END" if tests else "CAST(NULL AS STRING)"


def temporal_columns(wall: str, moment: str) -> dict[str, str]:
    """Calendar fields of the wall clock and the epoch second of the instant."""
    return {
        "hour_of_day": f"hour({wall})",
        "day_of_week": f"weekday({wall})",
        "day_of_month": f"day({wall})",
        "month": f"month({wall})",
        "year": f"year({wall})",
        "is_weekend": f"weekday({wall}) >= 5",
        "is_business_hours": f"hour({wall}) BETWEEN 9 AND 17",
        "is_night": f"hour({wall}) < 6 OR hour({wall}) >= 22",
        "quarter": f"quarter({wall})",
        "week_of_year": f"weekofyear({wall})",
        "unix_timestamp": f"unix_seconds({moment})",
    }


def derived_columns() -> dict[str, str]:
    """Ratios over columns that are already in the frame."""
    return {
        "amount_to_balance_ratio": "IF(account_balance > 0, amount / account_balance, 0.0D)",
        "combined_risk_score": "(risk_score + fraud_score) / 2",
        "is_unusual_time": "(hour_of_day < 6 OR hour_of_day > 22) AND is_weekend",
        "avg_transactions_per_day": "transaction_count / greatest(account_age_days, 1)",
    }


def clean(name: str, kind: str, max_chars: int | None = MAX_TEXT) -> str:
    """NaN and infinities become 0; text is stripped and cut."""
    if kind in ("double", "float"):
        return f"IF(isnan(`{name}`) OR abs(`{name}`) = double('inf'), 0.0D, `{name}`)"
    if kind == "string":
        stripped = f"btrim(`{name}`, '{WHITESPACE}')"
        return stripped if max_chars is None else f"substr({stripped}, 1, {max_chars})"
    return f"`{name}`"


def aliased(columns: dict[str, str]) -> list[str]:
    """Expressions with their names, for ``selectExpr``."""
    return [f"{expression} AS `{name}`" for name, expression in columns.items()]
