"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the pattern) is encoded by halves: both halves are encoded recursively and
their token lists are joined. A join re-encodes a window of tokens around the seam and widens it
until the tokens next to the window stay as they are. That test is exact: a token list is the
encoding of its bytes if and only if every pair of neighbours encodes to itself, so once the two
pairs at the window's edges pass, nothing outside can change. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import map_batches, python_batches, text_of

#: Pieces of up to so many bytes are leaves: their merges are applied directly, and remembered.
LEAF_BYTES = 6
#: Short pieces, and leaves and seams, of one generation of a worker's caches, which hold two: a
#: worker's memory is bounded (about 100 MB for pieces, 60 MB for the rest).
CACHE_PIECES, CACHE_PARTS = 200_000, 60_000


class _Memo(dict):
    """Results of ``fn`` by argument, filled on demand. When ``most`` are held they become the older
    generation, and the one before is dropped; what is asked for again moves to the younger. So
    frequent keys stay, where emptying the whole would lose them each time."""

    def __init__(self, fn: Callable, most: int) -> None:
        super().__init__()
        self.fn, self.most, self.older = fn, most, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.fn(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class _Pieces(_Memo):
    """Piece -> token ids; long pieces are not remembered."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        return super().__missing__(piece) if len(piece) <= 48 else self.fn(piece)


#: Letters, numbers and white space below U+0250, where ``re`` with plain classes does the same
#: as the general pattern, several times as fast.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \\t-\\r\u0085\u00a0"
GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts below U+0250, if it is the usual one."""
    if pattern != GENERAL:
        return None
    x, n, s = LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACE
    return re.compile(f" ?[{x}]+|'(?:[stmd]|re|ve|ll)| ?[{n}]+| ?[^{s}{x}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES) -> None:
        self.ranks, self.leaf = ranks, max(2, leaf)
        self.vocab = {i: b for b, i in ranks.items()}
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.beyond = re.compile("[^\0-\u024f]")
        self.pieces = _Pieces(lambda piece: tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass"))), CACHE_PIECES)
        self.leaves = _Memo(self.merge, CACHE_PARTS)
        self.seams = _Memo(lambda pair: self.merge(self.vocab[pair[0]] + self.vocab[pair[1]]), CACHE_PARTS)

    def merge(self, data: bytes) -> list[int]:
        """Apply the merges by rank: the leaf of the tree."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        get, far = ranks.get, 1 << 60
        cost = [get(parts[i] + parts[i + 1], far) for i in range(len(parts) - 1)]
        while cost:
            best = min(cost)
            if best == far:
                break
            i = cost.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = get(parts[i - 1] + parts[i], far)
            if i < len(cost):
                cost[i] = get(parts[i] + parts[i + 1], far)
        return [ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether two neighbours encode to themselves."""
        seam = self.seams[left, right]
        return len(seam) == 2 and seam[0] == left

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: the encoding of the concatenated bytes."""
        if not left or not right:
            return left or right
        window, width = self.seams[left[-1], right[0]], 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2
            window = self.merge(b"".join([self.vocab[t] for t in left[-width:] + right[:width]]))

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= self.leaf:
            return self.leaves[data]
        mid = len(data) // 2
        return self.join(self.encode_piece(data[:mid]), self.encode_piece(data[mid:]))

    def split(self, text: str) -> list[str]:
        if self.latin and not self.beyond.search(text):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        """Matches of the pattern are encoded separately, so their lists just concatenate."""
        pieces = self.pieces
        return list(chain.from_iterable([pieces[p] for p in self.split(text)]))

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.vocab.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def load_codec(path: str, pattern: str, leaf: int = LEAF_BYTES) -> Codec:
    """One codec per worker process. Its tables live as long as the worker: they are set apart, so
    the collector does not trace them again and again."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    codec = Codec(ranks, pattern, leaf)
    gc.freeze()
    return codec


def _encoded(codec: Codec, texts: pa.Array) -> pa.ListArray:
    lists = [np.array(codec.encode(t.as_py()), dtype=np.int32) for t in texts]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))


def _decoded(codec: Codec, ids: pa.ListArray) -> pa.Array:
    """Bytes of each list; an array that was cut from a longer one keeps its offsets."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([codec.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>`` for each row. Null or empty text: no ids. Repeated rows and ids give
    one row each; other columns are ignored. ``path`` is a vocabulary file on every worker."""
    python_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), _encoded(load_codec(path, pattern), batch.column(1))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key), text_of(docs, text).alias("text")), run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, ids, bytes`` for each row of ``encode``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(load_codec(path, pattern), ids)], names=[key, "ids", "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    return map_batches(encoded.select(key, "ids"), run, f"`{key}` {kind}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, bytes`` for each row: ``decode(encode(docs))`` in one Python stage, so a task has
    one worker with one codec."""
    python_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = load_codec(path, pattern)
        ids = _encoded(codec, batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(codec, ids)], names=[key, "ids", "bytes"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key), text_of(docs, text).alias("text")), run, f"`{key}` {kind}, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
