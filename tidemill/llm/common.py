"""Pieces that several operators of this package share."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def text_of(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def remainder(modulo: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, which deals documents to folds."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulo


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words. On bytes, ``lower`` and ``split`` know only ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    if not words:
        return np.empty(0, np.uint64)
    flat = np.empty(len(words), object)
    flat[:] = words
    codes, distinct = pd.factorize(flat)
    return pd.util.hash_array(distinct, categorize=False)[codes]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over the whole range."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def chain64(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and that of its last word."""
    return mix64(left * _ODD + mix64(right))
