"""Interpolated modified Kneser-Ney n-gram models in sorted hash arrays.

Words are counted first and numbered, frequent ones lowest. Tasks then count the
n-grams of their texts and send them to shards, already summed, as a few large
blobs of compressed word numbers; a shard sums what it gets and writes the sorted
64-bit hashes of the contexts, and of each the words that follow with their
counts. An n-gram goes to the shard of its context, so that the context's totals
arise there. If the context ends in one
of the few most frequent words, its n-grams are spread over all shards by their
own hash and the totals of the parts are added in the next step, in which the
distinct n-grams also become continuation counts of the next lower order.

Scoring tasks map the arrays into memory and look up the distinct n-grams of a
chunk of texts in sorted order. The model may be larger than any worker's
memory; its pages are shared by all workers of a machine. All arrays of a shard
and order share one file, which is mapped once and needs no open file meanwhile.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import chain64, mix64, text_of
from tidemill.session import discard, materialize, work_path

END = np.uint64(0x7C0A3D95_58E1F2A7)
_BLOB = "kind string, shard int, n bigint, payload binary"


def local_folder(path: str) -> str:
    """The path as files see it: models are memory-mapped, so it must be mounted."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} cannot be memory-mapped: name a folder that all executors mount")
    return parts.path


@dataclass
class Tokens:
    """Words of some texts: hashes of the distinct ones, the end first, and where each stands in them."""

    distinct: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, starts = split.flatten(), split.offsets.to_numpy()
        sizes = np.diff(starts).astype(np.int64)
        # White space at an end of a text leaves an empty word there.
        empty = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0)
        if len(empty):
            sizes -= np.bincount(np.searchsorted(starts, empty, side="right") - 1, minlength=len(sizes))
            flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        words = flat.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        hashed = pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.empty(0, np.uint64)
        return cls(np.concatenate([[END], hashed]), words.indices.to_numpy().astype(np.int64) + 1, sizes)

    def stream(self, names: np.ndarray, begin: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, where ``names`` has one per distinct word, and each text's number of tokens with its end.

        Every text is led by ``order - 1`` begin marks and followed by one end.
        """
        lead, sizes = order - 1, self.sizes
        stream = np.full(len(self.codes) + len(sizes) * (lead + 1), begin, np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes + lead + 1)[:-1]]) + lead
        text = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(self.codes)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        stream[starts[text] + within] = names[self.codes]
        stream[starts + sizes] = names[0]
        return stream, sizes + 1


def _positions(sizes: np.ndarray, order: int) -> np.ndarray:
    """Where the tokens of a stream stand, begin marks left out."""
    lead = order - 1
    return np.arange(sizes.sum()) + np.repeat(lead * np.arange(1, len(sizes) + 1), sizes)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    hashed = mix64(columns[0])
    for column in columns[1:]:
        hashed = chain64(hashed, column)
    return hashed


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of equal hashes added up, in the order of their hashes, which come last."""
    hashed = gram_hash(columns)
    order = np.argsort(hashed)
    hashed = hashed[order]
    first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
    total = np.add.reduceat(counts[order], first)
    return [c[order[first]] for c in columns], total, hashed[first]


def _range_of(hashed: np.ndarray, shards: int) -> np.ndarray:
    """The shard that holds a hash: equal ranges of the upper half."""
    return ((hashed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _shard_of(columns: list[np.ndarray], shards: int, frequent: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each n-gram, whose hashes are ``grams``, and whether its context is spread."""
    if len(columns) == 1:
        return _range_of(grams, shards), np.ones(len(grams), bool)
    spread = np.isin(columns[-2], frequent)
    return _range_of(np.where(spread, grams, gram_hash(columns[:-1])), shards), spread


_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Columns and counts byte by byte, without bytes that are zero in every row; of the first, which ascends, the steps."""
    steps = np.diff(columns[0], prepend=np.uint64(0))
    columns = [np.ascontiguousarray(c, np.uint64) for c in (steps, *columns[1:], counts)]
    used = [max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1 for c in columns]
    planes = [c.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for c, n in zip(columns, used)]
    head = np.array([len(columns), len(counts), *used], np.int64).tobytes()
    return head + _CODEC.compress(b"".join(planes), asbytes=True)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    width, n = np.frombuffer(blob, np.int64, 2).tolist()
    used = np.frombuffer(blob, np.int64, width, 16).tolist()
    planes = np.frombuffer(_CODEC.decompress(memoryview(blob)[16 + 8 * width :], n * sum(used), asbytes=True), np.uint8)
    columns, at = [], 0
    for size in used:
        column = np.zeros((n, 8), np.uint8)
        column[:, :size] = planes[at : at + n * size].reshape(size, n).T
        columns.append(column.view(np.uint64).reshape(-1))
        at += n * size
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns[:-1], columns[-1].astype(np.int64)


#: Bytes of blobs that travel in one batch: with many shards each is small.
BATCH_BYTES = 1 << 20


def _rows(kind: str, shard: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One blob per shard, in the order of the first two columns."""
    if len(columns) == 1:
        order = np.argsort(columns[0])
    elif columns[1].max() < 1 << 32 and columns[0].max() < 1 << 32:
        order = np.argsort(columns[0] << np.uint64(32) | columns[1])
    else:
        order = np.lexsort(columns[1::-1])
    shards, sizes, blobs, held = [], [], [], 0

    def batch():
        parts = [pa.array([kind] * len(shards)), pa.array(shards, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())]
        return pa.record_batch(parts, names=["kind", "shard", "n", "payload"])

    for s, own in _by_shard(shard[order]):
        own = order[own]
        blob = _pack([c[own] for c in columns], counts[own])
        shards.append(s), sizes.append(len(own)), blobs.append(blob)
        held += len(blob)
        if held >= BATCH_BYTES:
            yield batch()
            shards, sizes, blobs, held = [], [], [], 0
    if shards:
        yield batch()


def _count(order: int, shards: int, words: Words | None, frequent: np.ndarray, chunk_chars: int, held_rows: int):
    """N-grams of a task's texts, summed before they are sent; words count by their hashes until they are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        lookup = None if words is None else WordLookup(words)

        def flush():
            columns = [np.concatenate([p[i] for p in held]) for i in range(order)]
            columns, counts, grams = _summed(columns, np.concatenate([p[order] for p in held]))
            shard, _ = _shard_of(columns, shards, frequent, grams)
            return _rows("gram", shard, columns, counts)

        for batch in _merged_batches(batches, chunk_chars):
            tokens = Tokens.of(batch.column("text"))
            names = tokens.distinct if lookup is None else lookup.find(tokens.distinct)[0]
            if order == 1:
                times = np.bincount(tokens.codes, minlength=len(names))
                times[0] = len(tokens.sizes)
                held.append([names, times])
            else:
                stream, sizes = tokens.stream(names, 0 if words is None else words.begin, order)
                at = _positions(sizes, order)
                held.append([*(stream[at - (order - 1 - i)] for i in range(order)), np.ones(len(at), np.int64)])
            if sum(len(p[0]) for p in held) >= held_rows:
                yield from flush()
                held.clear()
        if held:
            yield from flush()
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return run


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays of one or two dimensions in one file, as bytes after a table of their names, kinds and shapes.

    All or nothing: a repeated task writes the same file again.
    """
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.npy"
    draft = f"{path}.{uuid.uuid4().hex}"
    table = json.dumps([[key, a.dtype.str, a.shape] for key, a in arrays.items()]).encode()
    parts = [np.array([len(table)], np.int64).tobytes(), table, *(a.tobytes() for a in arrays.values())]
    padded = [part + bytes(-len(part) % 8) for part in parts]
    with open(draft, "wb") as out:
        size = sum(map(len, padded))
        np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": (size,)})
        out.writelines(padded)
    os.replace(draft, path)


def _counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in one byte each, those of 255 and more beside them by their place in the flat array."""
    flat = counts.reshape(-1)
    large = np.flatnonzero(flat >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "large": np.stack([large.astype(np.int64), flat[large]])}


#: Contexts with more followers have their totals written; those of others are added up when they are looked up.
NARROW = 16


_ONE_OR_TWO = np.array([0, 1, 1 << 32, 0], np.int64)


def _context_stats(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each context its total and how many counts are one, two, and more; rows of a context begin at ``first``."""
    total = np.add.reduceat(counts, first)
    both = np.add.reduceat(_ONE_OR_TWO[np.minimum(counts, 3)], first)  # ones and twos in one pass
    ones, twos = both & 0xFFFFFFFF, both >> 32
    return np.stack([total, ones, twos, np.diff(first, append=len(counts)) - ones - twos])


def _by_context(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The places of rows in the order of contexts, and of words within each. Two plain sorts take less time than one by two keys."""
    order = np.argsort(contexts)
    sorted_ = contexts[order]
    group = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
    if len(words) and (int(words.max()) >= 1 << 32 or len(words) >= 1 << 32):
        return np.lexsort((words, contexts))
    return order[np.argsort(group << np.uint64(32) | words[order])]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not len(values) or values.max() < 1 << 32 else values


def _save_contexts(folder: str, name: str, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write contexts with their followers; returns where each begins and what it adds up to."""
    first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    stats = _context_stats(counts, first)
    starts = np.concatenate([first, [len(counts)]])
    wide = np.flatnonzero(np.diff(starts) > NARROW)
    wide = np.concatenate([wide[None], stats[:, wide]])
    _save(folder, name, key=contexts[first], start=_small(starts), word=_small(words), wide=wide, **_counts(counts))
    return first, stats


def _reduce(folder: str, order: int, shards: int, frequent: np.ndarray, pass_down: bool, name: str):
    """Write the arrays of a shard; send parts of spread contexts and continuations on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        totals: dict[int, list] = {}
        for batch in batches:
            for kind, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "payload"))):
                if kind in ("gram", "context"):
                    (held if kind == "gram" else totals).setdefault(shard, []).append(_unpack(payload))
        while totals:
            shard, parts = totals.popitem()
            # Contexts of the next higher order: their words and four numbers.
            columns = [np.concatenate([p[0][i] for p in parts]) for i in range(order + 4)]
            keys = gram_hash(columns[:order])
            sort = np.argsort(keys)
            keys = keys[sort]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = np.stack([np.add.reduceat(c[sort].astype(np.int64), first) for c in columns[order:]])
            _save(folder, f"{order + 1}-{shard}-spread", gram=keys[first], **_counts(sums))
        while held:
            shard, parts = held.popitem()
            columns = [np.concatenate([p[0][i] for p in parts]) for i in range(order)]
            columns, counts, grams = _summed(columns, np.concatenate([p[1] for p in parts]))
            del parts
            summary = {"n": [int((counts == i).sum()) for i in (1, 2, 3, 4)], "total": int(counts.sum()), "distinct": len(counts)}
            summary["more"] = int((counts >= 3).sum())
            if order == 1:
                _save(folder, f"{name}-{shard}", gram=grams, **_counts(counts))
            if name == "word":
                summary["ranks"] = np.bincount(_rank(counts), minlength=64).tolist()
            if order > 1:
                contexts = gram_hash(columns[:-1])
                sort = _by_context(contexts, columns[-1])
                first, stats = _save_contexts(folder, f"{name}-{shard}", contexts[sort], columns[-1][sort], counts[sort])
                first = sort[first]
                spread = np.isin(columns[-2][first], frequent)
                if spread.any():
                    key = [*(c[first[spread]] for c in columns[:-1]), *stats[:, spread].astype(np.uint64)]
                    yield from _rows("context", _range_of(contexts[first[spread]], shards), key, np.ones(spread.sum(), np.int64))
                if pass_down:
                    lower, known, hashed = _summed(columns[1:], np.ones(len(counts), np.int64))
                    target, _ = _shard_of(lower, shards, frequent, hashed)
                    yield from _rows("gram", target, lower, known)
            yield pa.record_batch(
                [pa.array(["summary"]), pa.array([shard], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([json.dumps(summary).encode()], pa.binary())],
                names=["kind", "shard", "n", "payload"],
            )

    return run


def _rank(counts: np.ndarray) -> np.ndarray:
    """0 to 63, halving counts for each step down; frequent words come first."""
    return 63 - np.frexp(counts.astype(np.float64))[1].clip(0, 63)


@dataclass
class Words:
    """Where the numbered words are: below ``distinct``, then the begin mark and whatever is unknown."""

    folder: str
    shards: int
    distinct: int

    @property
    def begin(self) -> int:
        return self.distinct

    @property
    def unknown(self) -> int:
        return self.distinct + 1


def _number(folder: str, ranks: dict[int, list[int]], least: int):
    """Number a shard's words, given the first number of each of its ranks; names those that count ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                words = _Table(folder, f"word-{shard}")
                counts = words.counts(np.arange(len(words.grams)))
                rank = _rank(counts)
                order = np.argsort(rank, kind="stable")
                before = np.searchsorted(rank[order], np.arange(64))
                numbers = np.empty(len(counts), np.uint64)
                numbers[order] = np.array(ranks[shard])[rank[order]] + np.arange(len(counts)) - before[rank[order]]
                _save(folder, f"word-{shard}-number", number=_small(numbers))
                yield pa.record_batch([pa.array(numbers[counts >= least].astype(np.int64))], names=["word"])

    return run


@dataclass
class Model:
    """Where the arrays are and the few numbers that hold for all shards."""

    folder: str
    order: int
    shards: int
    words: Words
    frequent: np.ndarray
    discounts: dict[int, list[float]]
    train_tokens: int
    vocabulary: int
    unigram: dict[str, int]


def _discounts(counts: list[int]) -> list[float]:
    """Of counts one, two, and three or more."""
    n1, n2, n3, n4 = counts
    if min(counts) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1)]


def _summaries(rows: DataFrame) -> dict[int, dict]:
    found = rows.filter("kind = 'summary'").select("shard", "payload").collect()
    return {r["shard"]: json.loads(bytes(r["payload"])) for r in found}


def _merged(rows: DataFrame) -> dict:
    found = list(_summaries(rows).values())
    merged = {k: sum(x[k] for x in found) for k in ("total", "distinct", "more")}
    return merged | {"n": [sum(x["n"][i] for x in found) for i in range(4)]}


def _first_numbers(rows: DataFrame) -> dict[int, list[int]]:
    """The first number of each rank of words in each shard."""
    found = _summaries(rows)
    shards = sorted(found)
    sizes = np.array([found[s]["ranks"] for s in shards], np.int64).reshape(-1, 64).T
    firsts = (np.cumsum(sizes) - sizes.reshape(-1)).reshape(sizes.shape)
    return {s: firsts[:, i].tolist() for i, s in enumerate(shards)}


def train(
    texts: DataFrame,
    order: int = 3,
    folder: str | None = None,
    chunk_chars: int = 1_000_000,
    held_rows: int = 800_000,
    shard_tokens: int = 1_000_000,
) -> Model:
    """Count a model over the column ``text``; null counts as empty.

    Words are counted in ``spark.sql.shuffle.partitions`` shards, n-grams in as
    many more as keep a shard at ``shard_tokens`` tokens on average; a task holds
    one shard. The driver gets a few sums per shard and the words that hold more than 1 / (8 shards) of all
    tokens, of which there are less than eight per shard.
    """
    spark = texts.sparkSession
    word_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_folder(folder or work_path(spark, "ngrams"))
    own = texts.select(text_of().alias("text"))
    none = np.empty(0, np.uint64)

    def step(rows: DataFrame, k: int, frequent: np.ndarray, name: str, shards: int) -> tuple[DataFrame, str]:
        dealt = rows.filter("kind <> 'summary'").repartitionById(shards, F.col("shard"))
        run, path = _reduce(folder, k, shards, frequent, k > 1, name), work_path(spark, f"ngrams-{name}")
        return materialize(dealt.mapInArrow(run, _BLOB), path), path

    counted, path = step(own.mapInArrow(_count(1, word_shards, None, none, chunk_chars, held_rows), _BLOB), 1, none, "word", word_shards)
    vocabulary = _merged(counted)
    shards = max(word_shards, -(-vocabulary["total"] // shard_tokens))
    number = _number(folder, _first_numbers(counted), max(2, vocabulary["total"] // (8 * shards)))
    full = counted.filter("kind = 'summary'").select("shard").mapInArrow(number, "word bigint")
    frequent = np.array([r["word"] for r in full.collect()], np.int64).view(np.uint64)
    discard(spark, path)
    words = Words(folder, word_shards, vocabulary["distinct"])
    rows, path = own.mapInArrow(_count(order, shards, words, frequent, chunk_chars, held_rows), _BLOB), None
    discounts, summary = {}, {}
    for k in range(order, 0, -1):
        rows, done = step(rows, k, frequent, str(k), shards)
        if path:
            discard(spark, path)
        path, summary = done, _merged(rows)
        discounts[k] = _discounts(summary["n"])
    discard(spark, path)
    return Model(folder, order, shards, words, frequent, discounts, vocabulary["total"], vocabulary["distinct"], summary)


class _Table:
    """One shard's sorted hashes and their counts, mapped into memory."""

    def __init__(self, folder: str, name: str):
        self.grams, self.small, self.large = _mapped(folder, name, "gram", "count", "large")

    def counts(self, at: np.ndarray, row: int | None = None) -> np.ndarray:
        """Counts at some places, of one row where each place has several."""
        found = (self.small if row is None else self.small[row])[at].astype(np.int64)
        top = np.flatnonzero(found == 255)
        if len(top):
            found[top] = self.large[1][np.searchsorted(self.large[0], at[top] + (row or 0) * self.small.shape[-1])]
        return found

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of hashes, 0 where there is none."""
        at, hit = _located(self.grams, hashes)
        found = np.zeros(len(hashes), np.int64)
        found[hit] = self.counts(at[hit])
        return found


class _Contexts(_Table):
    """One shard's sorted contexts, and of each the numbers of the words that follow, in order, with their counts."""

    def __init__(self, folder: str, name: str):
        parts = _mapped(folder, name, "key", "start", "word", "count", "large", "wide")
        self.keys, self.starts, self.words, self.small, self.large, self.wide = parts

    def places(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts the place in the order of keys, where their followers begin, and how many there are; 0 for unknown ones."""
        at, hit = _located(self.keys, contexts)
        if not len(self.keys):
            return at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin = self.starts[at].astype(np.int64)
        return at, begin, np.where(hit, self.starts[at + 1] - begin, 0)

    def search(self, low: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of words among the followers that begin at ``low``; 0 where there is none."""
        low, size = low.copy(), size.copy()
        for _ in range(int(size.max()).bit_length()):
            half = size >> 1
            low += half * (self.words[low + half - 1] < word)  # where half is 0, any word will do
            size -= half
        return np.where(self.words[low] == word, self.counts(low), 0)


#: A map keeps its file open unless told otherwise, and a worker may only have so many files open.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}

#: Files that a worker keeps mapped; a process may have 65530 maps, and by default often fewer open files.
MOST_MAPS = 40_000 if _UNTRACKED else 4_000


def _mapped(folder: str, name: str, *wanted: str) -> list[np.ndarray]:
    """Arrays of a file, which is mapped once; empty ones where there is no file."""
    try:
        with open(f"{folder}/{name}.npy", "rb") as file:
            held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED)
    except FileNotFoundError:
        return [np.empty((0,)) for _ in wanted]
    at = 10 + int.from_bytes(held[8:10], "little")  # where the header of the file ends
    size = int.from_bytes(held[at : at + 8], "little")
    table = json.loads(held[at + 8 : at + 8 + size])
    at += 8 + size + -size % 8
    found = {}
    for key, kind, shape in table:
        kind, n = np.dtype(kind), int(np.prod(shape))
        found[key] = np.frombuffer(held, kind, n, at).reshape(shape)
        at += n * kind.itemsize + -(n * kind.itemsize) % 8
    return [found[key] for key in wanted]


def _located(sorted_: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
    return at, sorted_[at] == hashes


def _sorted_by_shard(shard: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """The places of all rows by shard, each shard's in the order of ``key``."""
    order = np.arange(len(shard)) if key is None else np.argsort(key)
    small = shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard  # sorted by digits
    return order[np.argsort(small[order], kind="stable")]


def _by_shard(shard: np.ndarray, key: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard's rows, in the order of ``key``."""
    order = _sorted_by_shard(shard, key)
    names, starts = np.unique(shard[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, starts[1:]))


class WordLookup:
    """Numbers and raw counts of words by their hashes, in the mapped arrays; one per task."""

    def __init__(self, words: Words):
        self.words = words
        self.shards: dict[int, tuple[_Table, np.ndarray]] = {}

    def _shard(self, s: int) -> tuple[_Table, np.ndarray]:
        if s not in self.shards:
            name = f"word-{s}"
            self.shards[s] = _Table(self.words.folder, name), *_mapped(self.words.folder, f"{name}-number", "number")
        return self.shards[s]

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mix64(hashed)  # words are filed by their mixed hash
        numbers = np.full(len(keys), self.words.unknown, np.uint64)
        counts = np.zeros(len(keys), np.int64)
        for s, own in _by_shard(_range_of(keys, self.words.shards), keys):
            table, known = self._shard(s)
            at, hit = _located(table.grams, keys[own])
            numbers[own[hit]] = known[at[hit]]
            counts[own[hit]] = table.counts(at[hit])
        return numbers, counts


@dataclass
class Grams:
    """Distinct n-grams of some texts: their hashes, last words, contexts, and what the first word leaves of them.

    Contexts and tails are places among the distinct n-grams of the order below.
    """

    order: int
    hashes: np.ndarray
    word: np.ndarray
    context: np.ndarray | None = None
    tail: np.ndarray | None = None

    @classmethod
    def words(cls, numbers: np.ndarray) -> Grams:
        return cls(1, mix64(numbers), np.arange(len(numbers)))

    def longer(self, ids: np.ndarray, stream: np.ndarray, numbers: np.ndarray) -> tuple[Grams, np.ndarray]:
        """The n-grams one word longer and which of them ends at each place, given those of this order that do.

        Those that would begin before the stream, or end in a begin mark, mean nothing and are never asked for.
        """
        before = np.concatenate([ids[:1], ids[:-1]])
        places, pairs = pd.factorize(before * len(numbers) + stream)
        last = np.empty(len(pairs), np.int64)
        last[places] = np.arange(len(places))
        context, word = before[last], stream[last]
        hashes = chain64(self.hashes[context], numbers[word])
        return Grams(self.order + 1, hashes, word, context, ids[last]), places


class Scorer:
    """Looks up n-grams in the mapped arrays; one per task."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordLookup(model.words)
        self.tables: dict[str, _Table | _Contexts] = {}

    def _table(self, name: str, kind: type = _Table) -> _Table | _Contexts:
        found = self.tables.get(name)
        if found is None:
            found = kind(self.model.folder, name)
            if len(self.tables) < MOST_MAPS:  # others are mapped for each chunk anew
                self.tables[name] = found
        return found

    def _unigrams(self, grams: np.ndarray, shard: np.ndarray) -> np.ndarray:
        found = np.zeros(len(grams), np.int64)
        for s, own in _by_shard(shard, grams):
            found[own] = self._table(f"1-{s}").find(grams[own])
        return found

    def _followers(self, grams: Grams, lower: Grams, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of n-grams, and of each n-gram of the order below, as a context, its total and the sum of its discounts."""
        k, shards = grams.order, self.model.shards
        contexts, words = lower.hashes[grams.context], self.numbers[grams.word]
        spread = frequent[lower.word][grams.context]
        shard = _range_of(np.where(spread, grams.hashes, contexts), shards)
        if shards < 1 << 16:
            # The upper bits will do: contexts that share them may alternate, and are then looked up more than once.
            order = np.argsort(shard.astype(np.uint64) << np.uint64(48) | contexts >> np.uint64(16))
        else:
            order = _sorted_by_shard(shard, contexts)
        contexts, words, spread, shard = contexts[order], words[order], spread[order], shard[order]
        new = np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (shard[1:] != shard[:-1])])
        first = np.flatnonzero(new)  # of each context's n-grams in a shard
        group = np.cumsum(new) - 1
        keys, found = contexts[first], np.zeros(len(words), np.int64)
        size, stats = np.zeros(len(keys), np.int64), np.zeros((4, len(keys)), np.int64)
        known, counts = [], []
        names, begins = np.unique(shard[first], return_index=True)
        for s, start, stop in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)]):
            table = self._table(f"{k}-{s}", _Contexts)
            at, begin, own = table.places(keys[start:stop])
            wide = np.flatnonzero(own > NARROW)
            if len(wide):
                stats[:, start + wide] = table.wide[1:, np.searchsorted(table.wide[0], at[wide])]
                low, high = first[start], first[stop] if stop < len(first) else len(words)
                place = group[low:high] - start
                many = np.flatnonzero(own[place] > NARROW)
                found[low + many] = table.search(begin[place[many]], own[place[many]], words[low + many])
                own[wide] = 0
            size[start:stop] = own
            rows = np.repeat(begin - np.cumsum(own) + own, own) + np.arange(own.sum())
            if len(rows):
                known.append(table.words[rows].astype(np.uint64))
                counts.append(table.counts(rows))
        if known:
            known, counts = np.concatenate(known), np.concatenate(counts)
            some = np.flatnonzero(size)
            begin = np.cumsum(size) - size
            stats[:, some] = _context_stats(counts, begin[some])
            # Words below the whole vocabulary number each context's followers apart from all others'.
            width = np.uint64(self.model.words.unknown + 1)
            row = np.repeat(np.arange(len(size), dtype=np.uint64), size) * width + known
            narrow = np.flatnonzero(size[group])
            at, hit = _located(row, group[narrow].astype(np.uint64) * width + words[narrow])
            found[narrow[hit]] = counts[at[hit]]
        total, left = np.zeros(len(lower.hashes), np.int64), np.zeros(len(lower.hashes))
        whole = np.flatnonzero(~spread[first])
        place = grams.context[order[first[whole]]]
        total[place], left[place] = self._sums(k, stats[:, whole])
        # What a shard holds of a spread context is a part of it.
        parted = np.zeros(len(lower.hashes), bool)
        parted[grams.context[order[spread]]] = True
        parted = np.flatnonzero(parted)
        keys = lower.hashes[parted]
        for s, own in _by_shard(_range_of(keys, shards), keys):
            table = self._table(f"{k}-{s}-spread")
            at, hit = _located(table.grams, keys[own])
            if hit.any():
                place = parted[own[hit]]
                total[place], left[place] = self._sums(k, [table.counts(at[hit], row) for row in range(4)])
        result = np.empty(len(found), np.int64)
        result[order] = found
        return result, total, left

    def _sums(self, k: int, stats: np.ndarray | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals of contexts, and what their discounts take off them."""
        d1, d2, d3 = self.model.discounts[k]
        total, ones, twos, more = stats
        return total, d1 * ones + d2 * twos + d3 * more

    def _first_order(self, grams: Grams) -> np.ndarray:
        model = self.model
        d1, d2, d3 = model.discounts[1]
        count = self._unigrams(grams.hashes, _range_of(grams.hashes, model.shards))
        discount = np.choose(np.minimum(count, 3), [0.0, d1, d2, d3])
        total, (ones, twos, _, _) = model.unigram["total"], model.unigram["n"]
        rest = 1 / (model.vocabulary + 1)
        if not total:
            return np.full(len(count), rest)
        left = (d1 * ones + d2 * twos + d3 * model.unigram["more"]) / total
        return (count - discount) / total + left * rest

    def _next_order(self, grams: Grams, lower: Grams, below: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        d1, d2, d3 = self.model.discounts[grams.order]
        count, total, left = self._followers(grams, lower, frequent)
        discount = np.choose(np.minimum(count, 3), [0.0, d1, d2, d3])
        seen = (total > 0)[grams.context]
        total = np.maximum(total, 1)
        left = left / total
        below = below[grams.tail]
        return np.where(seen, (count - discount) / total[grams.context] + left[grams.context] * below, below)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Of each text: n_tokens, n_known, base_score and score, logarithms to 10."""
        model = self.model
        tokens = Tokens.of(texts)
        numbers, counts = self.words.find(tokens.distinct)
        self.numbers = np.append(numbers, np.uint64(model.words.begin))
        frequent = np.isin(self.numbers, model.frequent)
        begin = len(numbers)
        stream, sizes = tokens.stream(np.arange(begin, dtype=np.uint64), begin, model.order)
        stream = stream.astype(np.int64)
        at = _positions(sizes, model.order)
        grams, ids = Grams.words(self.numbers), stream
        chances = self._first_order(grams)
        for _ in range(1, model.order):
            lower = grams
            grams, ids = lower.longer(ids, stream, self.numbers)
            chances = self._next_order(grams, lower, chances, frequent)
        logs = np.log10(chances)[ids[at]]
        logs_of_words = np.log10((counts + 1) / (model.train_tokens + model.vocabulary + 1))
        of_word = stream[at]
        base, known = logs_of_words[of_word], (counts > 0)[of_word]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return {
            "n_tokens": sizes,
            "n_known": np.add.reduceat(known.astype(np.int64), starts),
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(logs, starts),
        }


def score_texts(docs: DataFrame, model: Model, chunk_chars: int = 2_000_000) -> DataFrame:
    """The columns of ``docs`` without ``text``, with n_tokens, n_known, base_score and score.

    ``score`` is the model's log10 probability of the text's words and its end,
    ``base_score`` that of add-one word counts. Null text counts as empty and
    has one token, its end. Columns named as the new ones are replaced. A model
    without training texts gives every token the probability 1.
    """
    added = ["n_tokens", "n_known", "base_score", "score"]
    carried = [c for c in docs.columns if c not in (*added, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in _merged_batches(batches, chunk_chars):
            found = scorer.score(batch.column("text"))
            yield pa.record_batch(
                [*(batch.column(c) for c in carried), *(pa.array(found[c]) for c in added)], names=[*carried, *added]
            )
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    fields = docs.select(*[F.col(f"`{c}`") for c in carried]).schema.fields
    schema = T.StructType(
        [*fields, *(T.StructField(c, T.LongType() if c.startswith("n_") else T.DoubleType()) for c in added)]
    )
    return docs.select(*[F.col(f"`{c}`") for c in carried], text_of().alias("text")).mapInArrow(run, schema)


def _merged_batches(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to about so many characters; none is empty."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy())
        start = 0
        while start < batch.num_rows:
            done = lengths[start - 1] if start else 0
            stop = int(np.searchsorted(lengths, done + chars - size)) + 1
            part = batch.slice(start, stop - start)
            held.append(part)
            size += int(lengths[min(stop, batch.num_rows) - 1] - done)
            start = stop
            if size >= chars:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
