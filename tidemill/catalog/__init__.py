"""Every operator as a named query over the supplied tables, with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.catalog.registry import ORACLES, QUERIES

SECTIONS = (
    "sources",
    "sinks",
    "records",
    "validation",
    "joins",
    "aggregates",
    "timeframes",
    "ordered",
    "scalars",
    "labels",
    "store",
    "streams",
    "training",
    "monitoring",
    "jobs",
)


def load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"tidemill.catalog.{section}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
