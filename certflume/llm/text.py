"""Words and word windows of an Arrow string array, as numpy arrays.

All documents of a batch are cut at once over the array's byte buffer, so the
cost is a few passes over the bytes and nothing per word is a Python object.
Words get 64-bit hashes that run over their bytes eight at a time, each step
mixed before the next, so no algebra of the bytes makes two words meet. What
decides a result is compared by its bytes (`Words.codes`) or by hashes of two
seeds, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of two independent hashes of a word.
SEED, CHECK_SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WINDOW_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def byte_table(breaks) -> np.ndarray:
    """256 booleans: does a byte belong to a word?"""
    table = np.ones(256, bool)
    table[list(breaks)] = False
    return table


#: Words of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: The lowest i bytes of a lane.
_LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Hashes of byte ranges."""
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    long = size > LONG_WORD
    live = np.flatnonzero((size > 0) & ~long)
    at = 0
    while len(live):
        rest = size[live] - at
        lane = lanes[start[live] + at] & _LANE_MASK[np.minimum(rest, 8)]
        h[live] = mix(h[live] ^ lane * np.uint64(seed | 1))
        live = live[rest > 8]
        at += 8
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


@dataclass
class Words:
    """start and end: byte ranges in `bytes`; of document d: words first[d] to first[d + 1]."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = SEED) -> np.ndarray:
        return range_hashes(self.bytes, self.start, self.end, seed)

    def array(self) -> pa.Array:
        """The words as a binary array."""
        size = self.end - self.start
        edge = np.zeros(len(self.bytes) + 1, np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1
        inside = self.bytes[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(inside)])

    def codes(self) -> np.ndarray:
        """Numbers of the words, equal where the bytes are equal."""
        return self.array().dictionary_encode().indices.to_numpy().astype(np.int64)

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i]:self.end[i]].tobytes()


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(array: pa.Array, table: np.ndarray, lower: bool) -> Words:
    data, offsets = string_bytes(array)
    if lower:
        data = lower_table()[data]
    inside = table[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    edge = offsets[:-1][full]
    start[edge] = inside[edge]
    edge = offsets[1:][full] - 1
    end[edge] = inside[edge]
    first_byte = np.flatnonzero(start)
    return Words(data, first_byte, np.flatnonzero(end) + 1, np.searchsorted(first_byte, offsets))


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive words, documents not regarded; empty if there are fewer than k.

    Windows of 1, 2, 4, ... words are made from each other; those that k is the sum of are joined.
    """
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, size = np.full(n, k, np.uint64), 0, word_hash, 1
    while size <= k:
        if k & size:
            out = mix(out * WINDOW_FACTOR + level[at:at + n])
            at += size
        if 2 * size <= k:
            level = mix(level[:-size] * WINDOW_FACTOR + level[size:])
        size *= 2
    return out


def within(w: Words, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie in one document."""
    n = max(len(w) - k + 1, 0)
    last = np.repeat(w.first[1:], w.counts)[:n]
    return np.flatnonzero(np.arange(n) + k <= last)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece's texts have `size` bytes at most, or it is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(string_bytes(batch.column(column))[1])
        begin = total = 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and total + n > size:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)
