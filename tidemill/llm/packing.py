"""Sum-of-squares packing of tokenized documents into sequences.

Pieces shorter than a sequence are dealt to shards of bounded size by hash. In a
shard, long pieces first, each piece goes where the sum of squares of the
numbers of open bins with each residual gap becomes smallest; a new bin is
opened where no open one has room. Whole sequences need no packing. Token ids are written once and
never travel with the packing, which sees lengths only.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import text_of
from tidemill.session import work_path

PIECES = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
_PLACES = "row bigint, piece int, sequence_id bigint, offset bigint"
_MEMO_WORDS = 1_500_000
#: Marks that often follow a word; each is a token by itself between a letter and white space.
_MARKS = ".,;:!?"
_ENCODERS: dict[str, "_Encoder"] = {}


def _little(ids: array) -> array:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class _Encoder:
    """Ids of texts, word by word, with a memory for words.

    A byte-level pattern never lets a token span the place before a single
    space or line end between two printing characters, nor that between letters
    and a closing mark, so a text may be cut there. Texts with other white space
    beside a space or line end, and texts that hold one of the tokenizer's added
    tokens, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [token.content for token in self.model.get_added_tokens_decoder().values()]
        # Ids of a word with the space before it, or of a line end and the word after it.
        self.memo: dict[str, bytes] = {}
        # Byte-level vocabularies write a space and a line end as these letters.
        self.begins = np.zeros(self.model.get_vocab_size(), bool)
        for token, number in self.model.get_vocab().items():
            self.begins[number] = token.startswith(("\u0120", "\u010a"))
        self.marks = {mark: ids for mark, ids in zip(_MARKS, self._encode(list(_MARKS)))}

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [_little(array("I", x.ids)).tobytes() for x in done]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word with a space before it; some hundred words are one text."""
        for start in range(0, len(words), 200):
            part = words[start : start + 200]
            raw = self._encode(["".join([w if w[0] == "\n" else " " + w for w in part])])[0]
            cuts = 4 * np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")])
            ends = [*cuts[1:].tolist(), len(raw)]
            yield from (raw[a:b] for a, b in zip(cuts.tolist(), ends))

    def _learn(self, words: set[str]) -> None:
        """Remember new words; those that must not be cut off from their neighbours stay unknown."""
        memo, marked, safe = self.memo, [], set()
        for word in words:
            body = word[1:] if word[:1] == "\n" else word
            if not body or body[0].isspace() or body[-1].isspace():
                continue
            if word[-1] in self.marks and body[:-1].isalpha():
                marked.append(word)
                if word[:-1] not in memo:
                    safe.add(word[:-1])
            else:
                safe.add(word)
        safe = list(safe)
        memo.update(zip(safe, self._encode_words(safe), strict=True))
        for word in marked:
            memo[word] = memo[word[:-1]] + self.marks[word[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.begins.any():  # not byte-level
            return self._encode(texts)
        if len(self.memo) > _MEMO_WORDS:
            self.memo.clear()
        get = self.memo.get
        cut = [text.replace("\n", " \n").split(" ") for text in texts]
        # The head has no space before it and is encoded by itself.
        parts = [list(map(get, words)) for words in cut]
        gaps = [[j for j, ids in enumerate(own) if ids is None and j] for own in parts]
        self._learn({words[j] for words, missing in zip(cut, gaps) for j in missing})
        found = self._encode([words[0] for words in cut])
        for i, (text, words, own, missing) in enumerate(zip(texts, cut, parts, gaps)):
            own[0] = found[i]
            for j in missing:
                own[j] = get(words[j])
                if own[j] is None:
                    break
            else:
                if not any(token in text for token in self.added):
                    found[i] = b"".join(own)
                    continue
            found[i] = self._encode([text])[0]
        return found


def encoder(path: str) -> _Encoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _tokenize(path: str, end_id: int, size: int, chunk_chars: int):
    end = np.array([end_id], "<u4").tobytes()

    def chunks(batches):
        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if chars >= chunk_chars:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        row = TaskContext.get().partitionId() << 36
        for doc_ids, texts in chunks(batches):
            out = []
            for doc_id, ids in zip(doc_ids, encode(texts)):
                ids += end
                total, start, piece = len(ids) // 4, 0, 0
                length = total % size or min(total, size)
                while start < total:
                    out.append((row, doc_id, piece, start, length, ids[4 * start : 4 * (start + length)]))
                    start, piece, length = start + length, piece + 1, size
                row += 1
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["row", "doc_id", "piece", "start", "length", "ids"],
            )

    return run


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, chunk_chars: int = 1_000_000
) -> DataFrame:
    """Pieces of at most ``size`` ids, written once: row, doc_id, piece, start, length, ids.

    ``ids`` are little-endian unsigned 32-bit numbers and end with ``end_id``. A
    document that is longer than ``size`` is cut into pieces of ``size`` ids, of
    which the first may be shorter. ``row`` names the input row, since an id may
    be null or come twice; null or empty text is the end id alone. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = work_path(spark, "pieces")
    pieces = docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _tokenize(tokenizer, end_id, size, chunk_chars), PIECES
    )
    pieces.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)  # by residual gap; full and unopened bins never count
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, length in enumerate(lengths.tolist()):
        # Change of the sum of squares for a bin of gap g: one bin less at g, one more at g - length.
        change = 2 * (count[: size + 1 - length] - count[length:]) + 2
        change[0] -= 1  # a full bin is counted nowhere
        change[count[length:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if count[best + length]:
            gap = best + length
            bin_ = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_, made = size, made, made + 1
        bins[i], offsets[i] = bin_, size - gap
        if gap > length:
            open_bins[gap - length].append(bin_)
            count[gap - length] += 1
    return bins, offsets


def _pack(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        bins, offsets = sum_of_squares(group["length"].to_numpy(), size)
        return pd.DataFrame(
            {"row": group["row"], "piece": group["piece"], "sequence_id": group["shard"] + bins, "offset": offsets}
        )

    return run


def place_pieces(pieces: DataFrame, size: int = 1024, shard_pieces: int = 50_000) -> DataFrame:
    """Places of pieces: row, piece, sequence_id, offset.

    A shard is packed by one task and holds about ``shard_pieces`` pieces
    whatever their number; sequences of different shards never mix.
    """
    narrow = pieces.select("row", "piece", "length")
    short = narrow.filter(F.col("length") < size)
    shards = max(1, -(-short.count() // shard_pieces))
    dealt = short.withColumn("shard", F.expr(f"shiftleft(pmod(xxhash64(row, piece), {shards}) * 2 + 1, 32)"))
    packed = dealt.groupBy("shard").applyInPandas(_pack(size), _PLACES)
    # Whole sequences are numbered below zero.
    whole = narrow.filter(F.col("length") == size).select(
        "row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces with their ids and places in sequences of at most ``size`` ids."""
    pieces = tokenize_pieces(docs, tokenizer, size, end_id)
    return pieces.join(place_pieces(pieces, size), ["row", "piece"])
