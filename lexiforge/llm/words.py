"""Vectorised kernels over Arrow string columns: word spans and 64-bit word hashes without a Python loop per word.

A word's hash takes in eight bytes at a time, each through a bijective mixer; of a word above LONG_WORD bytes all the rest
goes in as a BLAKE2 digest. Two different words share a hash with probability about 2**-64; operators that count words by
hash say so, and those that must be exact compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19  # texts handled at once; a longer text is a block of its own
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: A word of the quality, mixing and scoring operators is a run of bytes other than space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Consecutive rows of a batch: bytes, and each row's start in them (one more at the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts, in order, about ``limit`` bytes at a time; null counts as empty."""
    arr = as_strings(column)
    if not len(arr):
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Starts and ends (bytes) of a block's words, and each row's first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of the bytes in ``inside``; no word crosses two rows."""
    n = len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(block) + 1, np.int64))
    mask = inside[block.data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    edges = block.offsets[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    last = block.offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(block: Block, w: Words, lower: bool = False) -> np.ndarray:
    """uint64 for each word; lower: A-Z count as a-z."""
    data = _LOWER[block.data] if lower else block.data
    size = w.ends - w.starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, some, eight = 0, np.arange(len(size)), eights(data)
    while len(some):
        left = size[some] - at
        out[some] = mix(out[some] ^ (eight[w.starts[some] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
        at += 8
        some = some[left > 8]
        if at == LONG_WORD:
            for i in some.tolist():
                rest = hashlib.blake2b(data[w.starts[i] + at : w.ends[i]].tobytes(), digest_size=8).digest()
                out[i : i + 1] = mix(out[i : i + 1] ^ np.frombuffer(rest, "<u8"))
            break
    return out


def windows(h: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words within a row, and the index of its first word; rows with fewer words give none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = w.row
    at = np.flatnonzero(row[: n] == row[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[at + i])
    return out, at
