"""Encodings shared by training and scoring, and notebook scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.config import Mapping
from tidemill.functions.payload import text_to_double

NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def hash_encode(value: Column, modulo: int = 100) -> Column:
    """CRC-32 of the UTF-8 text, modulo the number of buckets."""
    return (F.crc32(value.cast("string").cast("binary")) % modulo).cast("int")


def python_text(value: Column, kind: str) -> Column:
    """Text of a value as Python prints it; booleans are capitalised."""
    if kind == "boolean":
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")


def bool_to_int(value: Column, kind: str) -> Column:
    """1 for true, nonzero numbers and true words; 0 for the rest and null."""
    if kind == "boolean":
        test = value
    elif kind in NUMBERS or kind.startswith("decimal"):
        test = value != 0
    elif kind == "string":
        # Words that count as true.
        test = F.lower(value).isin("true", "1", "yes")
    else:
        test = F.lit(False)
    return F.when(test, 1).otherwise(0)


def coerce_numeric(value: Column, kind: str) -> Column:
    """The number in a value, 0 when there is none."""
    if kind == "boolean":
        return F.coalesce(value.cast("int"), F.lit(0))
    if kind in NUMBERS or kind.startswith("decimal"):
        return F.coalesce(value, F.lit(0))
    if kind == "string":
        number = text_to_double(value)
        unusable = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        return F.when(unusable, F.lit(0.0)).otherwise(number)
    return F.lit(0)


def apply_transform(mapping: Mapping, value: Column, kind: str) -> Column:
    """One encoding of the model definition; unknown kinds give 0."""
    if mapping.kind == "hash_encode":
        return F.coalesce(hash_encode(python_text(value, kind), mapping.modulo), F.lit(0))
    if mapping.kind == "bool_to_int":
        return bool_to_int(value, kind)
    if mapping.kind == "numeric":
        return coerce_numeric(value, kind)
    return F.lit(0)


def interaction(risk: Column, amount: Column) -> Column:
    return risk * amount


def unusual_hour(hour: Column) -> Column:
    """1 before six and after twenty-two."""
    return F.when((hour < 6) | (hour > 22), 1).otherwise(0)


# Edges of the age buckets and codes of payment methods.
AGE_EDGES = (18, 25, 35, 45, 55, 65, 100)
PAYMENT_CODES = {"credit": 1, "debit": 2, "cash": 3}


def age_bucket(age: Column, edges: tuple[int, ...] = AGE_EDGES) -> Column:
    """Number of edges at or below the age: 0 below the first, 7 from the last on."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(age >= edge, 1).otherwise(0)
    return F.when(age.isNotNull(), total)


def literal_code(value: Column, codes: dict[str, int], default: int = 0) -> Column:
    """Code of a text from a fixed table."""
    pairs = [part for key, code in codes.items() for part in (F.lit(key), F.lit(code))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def ordinal_code(value: Column, ordered: tuple[str, ...], default: int = -1) -> Column:
    """Position of a text in an ordered list."""
    return literal_code(value, {name: i for i, name in enumerate(ordered)}, default)


def location_hash(city: Column, state: Column, modulo: int = 1000) -> Column:
    """Bucket of ``city_state``; CRC-32 because a process-seeded hash is not repeatable."""
    return hash_encode(F.concat(city, F.lit("_"), state), modulo)


def one_hot(value: Column, categories: list[str]) -> dict[str, Column]:
    """One 0/1 column per category; unknown values are 0 everywhere."""
    return {name: F.coalesce((value == name).cast("int"), F.lit(0)) for name in categories}
