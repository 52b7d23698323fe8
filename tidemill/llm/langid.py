"""Language identification by inferring a mixture of languages.

Each language is a distribution over hashed letter trigrams, counted over all
labelled training texts. A document is a mixture of languages: expectation
maximisation estimates its proportions from the trigrams' likelihoods. The set
of languages grows from the most likely single one as long as the gain in log
likelihood exceeds a penalty that grows with the logarithm of the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import text_of

UNKNOWN = "und"
_COUNTS = "lang string, bucket int, n bigint"
_JUDGED = (
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("languages", T.MapType(T.StringType(), T.DoubleType())),
)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash bucket of each letter with its two neighbours.

    Letters are lower-cased; any run of other characters is one space.
    """
    lowered = [" " + x.lower() + " " for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(x) for x in lowered])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashed = (codes[at - 1] * np.uint64(0x9E3779B1)) ^ (codes[at] * np.uint64(0x85EBCA6B)) ^ (codes[at + 1] * np.uint64(0xC2B2AE35))
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    return doc[at], (hashed >> np.uint64(64 - bits)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about so many characters; ``text`` is never null here."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.array([len(x) for x in batch.column("text").to_pylist()]))
        cuts = np.flatnonzero(np.diff(sizes // chars)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def _count(bits: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for chunk in _chunks(batches, chars):
            doc, bucket = trigrams(chunk.column("text").to_pylist(), bits)
            names, codes = np.unique(np.array(chunk.column("label").to_pylist(), object).astype(str), return_inverse=True)
            for i, name in enumerate(names):
                held = np.bincount(bucket[codes[doc] == i], minlength=1 << bits)
                totals[name] = totals.get(name, 0) + held
        for name, held in totals.items():
            at = np.flatnonzero(held)
            yield pa.record_batch(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return run


class LanguageModel:
    """Log probabilities of trigram buckets, one column per language."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    def infer(self, texts: list[str], bits: int, penalty: float, rounds: int) -> list[dict[str, float]]:
        """Proportions of the selected languages; nothing for a text without letters."""
        found: list[dict[str, float]] = [{} for _ in texts]
        if not self.names:
            return found
        doc, bucket = trigrams(texts, bits)
        pairs, weight = np.unique((doc << bits) | bucket, return_counts=True)
        if not len(pairs):
            return found
        doc, logs = pairs >> bits, self.logs[pairs & ((1 << bits) - 1)]
        docs, starts = np.unique(doc, return_index=True)
        lengths = np.diff(np.append(starts, len(doc)))
        letters = np.add.reduceat(weight, starts).astype(float)
        # Scaled so that the most likely language of each trigram has 1.
        top = logs.max(axis=1)
        scaled = np.exp(logs - top[:, None])
        single = np.add.reduceat((logs - top[:, None]) * weight[:, None], starts)
        chosen = np.zeros(single.shape, bool)
        chosen[np.arange(len(docs)), single.argmax(axis=1)] = True
        share, gained = chosen.astype(float), single.max(axis=1)

        def fit(rows: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            use = np.repeat(rows, lengths)
            own, w = scaled[use], weight[use][:, None]
            sizes = lengths[rows]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            theta = mask / mask.sum(axis=1, keepdims=True)
            for _ in range(rounds):
                part = own * np.repeat(theta, sizes, axis=0)
                total = part.sum(axis=1, keepdims=True)
                theta = np.add.reduceat(part * (w / total), first) / letters[rows][:, None]
            total = np.log((own * np.repeat(theta, sizes, axis=0)).sum(axis=1))
            return theta, np.add.reduceat(total * w[:, 0], first)

        if len(self.names) > 1:
            # Languages join in the order of their share in the full mixture.
            everything = np.ones(len(docs), bool)
            theta, _ = fit(everything, np.ones(single.shape))
            theta[chosen] = 2.0
            order = np.argsort(-theta, axis=1, kind="stable")
            active = everything
            for k in range(1, len(self.names)):
                mask = chosen.copy()
                mask[np.arange(len(docs)), order[:, k]] = True
                fitted, reached = fit(active, mask[active].astype(float))
                rows = np.flatnonzero(active)
                better = reached - gained[rows] > penalty * np.log(letters[rows] + 1)
                won = rows[better]
                chosen[won], share[won], gained[won] = mask[won], fitted[better], reached[better]
                active = np.zeros(len(docs), bool)
                active[won] = True
                if not len(won):
                    break
        for i, d in enumerate(docs.tolist()):
            found[d] = {self.names[j]: float(share[i, j]) for j in np.flatnonzero(chosen[i])}
        return found


def learn(labelled: DataFrame, bits: int = 16, smoothing: float = 0.5, chunk_chars: int = 1_000_000) -> LanguageModel:
    """Count trigrams of all rows (text, label) whose label is not null.

    A task sums its own rows first, so a label that holds most rows is no larger
    a group than any other. The model has languages x ``2 ** bits`` numbers.
    """
    rows = labelled.filter(F.col("label").isNotNull()).select(text_of().alias("text"), "label")
    counts = rows.mapInArrow(_count(bits, chunk_chars), _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    held = np.full((1 << bits, len(names)), smoothing)
    held[counts["bucket"], pd.Categorical(counts["lang"], names).codes] += counts["n"]
    return LanguageModel(names, np.log(held / held.sum(axis=0, keepdims=True)) if names else held)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    bits: int = 16,
    penalty: float = 4.0,
    rounds: int = 6,
    chunk_chars: int = 500_000,
) -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and languages behind them.

    ``languages`` maps the selected languages to their shares, ``lang_pred`` is
    the largest and ``score`` its share. Null texts, texts without letters and
    models without languages give ``und``, 0 and an empty map. Rows keep their
    place; columns named as the three new ones are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.names, model.logs))
    added = [field.name for field in _JUDGED]
    carried = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            shares, at = [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < chunk_chars):
                    chars += len(texts[end] or "")
                    end += 1
                shares += own.infer([x or "" for x in texts[at:end]], bits, penalty, rounds)
                at = end
            best = [max(x, key=x.get) if x else UNKNOWN for x in shares]
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array(best, pa.string()),
                    pa.array([min(1.0, x[b]) if x else 0.0 for x, b in zip(shares, best)], pa.float64()),
                    pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64())),
                ],
                names=[*batch.schema.names, *added],
            )

    return carried.mapInArrow(run, T.StructType([*carried.schema.fields, *_JUDGED]))
