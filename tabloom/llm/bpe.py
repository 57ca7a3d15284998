"""Byte-level BPE: a hierarchical bitmap of merge ranks as the queue of one pre-token.

A bucket per merge rank holds the linked-list positions whose pair has that rank; bitmaps of
64-bit words over the ranks, and over their words in turn, give the next rank by find-first-set.
Entries whose pair has changed since are skipped. A pre-token of n bytes needs O(n log n) steps,
however long it is.

Spark splits texts into pre-tokens; a task encodes each distinct pre-token of a batch once and
puts the ids of all texts together with array operations.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_or_empty

#: Bytes, estimated, of the pre-tokens that a task remembers with their ids; beyond them only
#: those of the last run stay. ENTRY is the cost of one besides its text and ids.
MEMORY = 32 << 20
ENTRY = 220
#: Pre-tokens that are laid out at once; a single longer text is one layout.
SLICE = 500_000
#: Ids that are decoded at once, a longer document's all together.
DECODED = 500_000
#: Bytes up to which a pre-token's positions are kept as bits of one number.
SHORT = 128


class RankQueue:
    """Positions by merge rank; the smallest rank first, within it the leftmost position."""

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            was = level[word]
            level[word] = was | bit
            if was:
                return
            rank = word

    def pop(self) -> tuple[int, int] | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank, bucket = at, self.buckets[at]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            for level in self.levels:
                word = at >> 6
                level[word] &= ~(1 << (at & 63))
                if level[word]:
                    break
                at = word
        return rank, position


class Encoder:
    """Encodes and decodes pre-tokens by the ranks of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.flat = np.frombuffer(b"".join(self.ranks), np.uint8)
        self.sizes, self.starts = np.zeros((2, max(self.ranks.values()) + 1), np.int64)
        order = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        self.sizes[order] = lengths = np.fromiter(map(len, self.ranks), np.int64, len(order))
        self.starts[order] = np.cumsum(lengths) - lengths

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest-ranked pair, leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._encode_short(piece) if len(piece) <= SHORT else self._encode_long(piece)

    def _encode_short(self, piece: bytes) -> list[int]:
        """The queue of a short pre-token in local names: two levels of wide words, positions as bits."""
        rank_of = self.ranks.get
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [rank_of(piece[k : k + 2]) for k in range(n - 1)]
        pair.append(None)
        upper, lower, buckets = 0, {}, {}
        waiting = [(rank, k) for k, rank in enumerate(pair) if rank is not None]
        while True:
            for rank, k in waiting:
                if rank in buckets:
                    buckets[rank] |= 1 << k
                else:
                    buckets[rank] = 1 << k
                    word = rank >> 8
                    lower[word] = lower.get(word, 0) | 1 << (rank & 255)
                    upper |= 1 << word
            if not upper:
                break
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            positions = buckets[rank]
            k = (positions & -positions).bit_length() - 1
            positions &= positions - 1
            if positions:
                buckets[rank] = positions
            else:
                del buckets[rank]
                bits &= bits - 1
                lower[word] = bits
                if not bits:
                    upper &= upper - 1
            waiting = []
            if pair[k] != rank:
                continue  # stale
            gone = after[k]
            after[k] = follower = after[gone]
            pair[gone] = None
            new = None
            if follower < n:
                before[follower] = k
                new = rank_of(piece[k : after[follower]])
                if new is not None:
                    waiting.append((new, k))
            pair[k] = new
            previous = before[k]
            if previous >= 0:
                new = rank_of(piece[previous:follower])
                if new != pair[previous]:
                    pair[previous] = new
                    if new is not None:
                        waiting.append((new, previous))
        out, k = [], 0
        while k < n:
            out.append(rank_of(piece[k : after[k]]))
            k = after[k]
        return out

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same by `RankQueue`, whose cost does not grow with the number of positions in a bucket."""
        ranks = self.ranks
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [ranks.get(piece[k : k + 2]) for k in range(n - 1)] + [None]
        push, pop = self.queue.push, self.queue.pop
        for k in range(n - 1):
            if pair[k] is not None:
                push(pair[k], k)
        while (entry := pop()) is not None:
            rank, k = entry
            if pair[k] != rank:
                continue  # stale: this pair has been merged or has changed
            gone = after[k]
            follower = after[gone]
            after[k] = follower
            pair[gone] = None
            if follower < n:
                before[follower] = k
                new = ranks.get(piece[k : after[follower]])
            else:
                new = None
            pair[k] = new
            if new is not None:
                push(new, k)
            previous = before[k]
            if previous >= 0:
                new = ranks.get(piece[previous:follower])
                if new != pair[previous]:
                    pair[previous] = new
                    if new is not None:
                        push(new, previous)
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : after[k]]])
            k = after[k]
        return out

    def encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all pre-tokens, one after the other, and how many each one has."""
        found = [self.encode(piece.encode()) for piece in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends): what all ids stand for, one after the other, and where each id's bytes end."""
        return gathered(self.flat, self.starts[ids], self.sizes[ids])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): the pieces of `flat` that begin at `starts`, one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    at += np.arange(total, dtype=np.int32)
    return flat[at], ends


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pretokens(text: Column, pattern: str) -> Column:
    """The matches of a pre-token pattern, white space understood as in Unicode."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


class Layout:
    """Puts ids of distinct pre-tokens together for whole texts.

    `encode` gives (ids, sizes) of a list of pre-tokens. What was met is kept in one array of ids
    with a slot per pre-token, within `memory` bytes; a task makes its own and drops it at its end.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], run: int = SLICE, memory: int = MEMORY) -> None:
        self.encode, self.run, self.memory = encode, run, memory
        self._keep([], np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.slots = dict(zip(words, range(len(words)), strict=True))
        self.ids, self.sizes, self.held = ids, sizes, self._cost(words, ids)

    @staticmethod
    def _cost(words: list[str], ids: np.ndarray) -> int:
        return ENTRY * len(words) + sum(map(len, words)) + ids.nbytes

    def _found(self, words: list[str]) -> np.ndarray:
        """The slot of each of these distinct pre-tokens; unknown ones are encoded first."""
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(slots < 0)
        if len(unmet):
            new = [words[k] for k in unmet.tolist()]
            ids, sizes = self.encode(new)
            slots[unmet] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.slots.update(zip(new, slots[unmet].tolist(), strict=True))
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
            self.held += self._cost(new, ids)
        if self.held > self.memory:
            sizes = self.sizes[slots]
            self._keep(words, gathered(self.ids, (np.cumsum(self.sizes) - self.sizes)[slots], sizes)[0], sizes)
            slots = np.arange(len(words))
        return slots

    def __call__(self, words: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, offsets of the rows in them)."""
        bounds = words.offsets.to_numpy()
        first = 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + self.run, "right")) - 1)
            flat = words.values.slice(bounds[first], bounds[last] - bounds[first]).dictionary_encode()
            slots = self._found(flat.dictionary.to_pylist())
            starts = (np.cumsum(self.sizes) - self.sizes)[slots]
            index = flat.indices.to_numpy()
            ids, ends = gathered(self.ids, starts[index], self.sizes[slots][index])
            yield first, ids, np.concatenate(([0], ends))[bounds[first : last + 1] - bounds[first]]
            first = last


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for every row; ids is a binary of little-endian unsigned 32-bit ids.

    Null texts count as empty and have no ids. Repeated rows and null ids are kept as they are;
    other columns are ignored; an empty table gives an empty result. No special tokens: their
    strings are ordinary text. The vocabulary file must exist on every executor.
    """
    source = docs.select(F.col(id_col).cast("long").alias(id_col), pretokens(text_or_empty(text_col), pattern).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(_encoder(ranks_path).encode_all)
        for batch in batches:
            for first, ids, rows in layout(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(first, len(rows) - 1), pa.array(np.diff(rows), pa.int64()), _cut(ids.tobytes(), 4 * rows)], names=[id_col, "n_tokens", "ids"])

    return source.mapInArrow(run, f"{id_col} long, n_tokens long, ids binary")


def _cut(held: bytes | np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(held)])


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, bytes): `encoded` with the bytes that its ids stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            bounds = np.concatenate(([0], np.cumsum([len(x or b"") // 4 for x in blobs])))
            first = 0
            while first < len(blobs):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + DECODED, "right")) - 1)
                ids = np.frombuffer(b"".join(x or b"" for x in blobs[first:last]), "<u4")
                held, ends = encoder.decode(ids)
                texts = _cut(held, np.concatenate(([0], ends))[bounds[first : last + 1] - bounds[first]])
                yield pa.record_batch([*batch.slice(first, last - first).columns, texts], names=[id_col, "n_tokens", "ids", "bytes"])
                first = last

    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"{id_col} long, n_tokens long, ids binary, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, bytes) for every row: `decode` of `encode` in one pass through Python.

    What is decoded are the ids as they are written, read back from their bytes. Nulls, repeated
    rows, other columns and empty tables as in `encode`.
    """
    source = docs.select(F.col(id_col).cast("long").alias(id_col), pretokens(text_or_empty(text_col), pattern).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        layout = Layout(encoder.encode_all)
        for batch in batches:
            for first, ids, rows in layout(batch.column(1)):
                packed = ids.tobytes()
                held, ends = encoder.decode(np.frombuffer(packed, "<u4"))
                columns = [batch.column(0).slice(first, len(rows) - 1), pa.array(np.diff(rows), pa.int64()), _cut(packed, 4 * rows), _cut(held, np.concatenate(([0], ends))[rows])]
                yield pa.record_batch(columns, names=[id_col, "n_tokens", "ids", "bytes"])

    return source.mapInArrow(run, f"{id_col} long, n_tokens long, ids binary, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding every text."""
    decoded = round_trip(docs, ranks_path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_bpe_rank_queue(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
