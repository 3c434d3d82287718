"""Smallest md5 digests over the shingles of a text, for many prefixes: md5 as NumPy operations on many strings at once.

Where the session has a JVM, Minima.java does the same work there, several times as fast, and only hex is made here.

Only the first 32 bits of each digest are computed for every string; which string is smallest nearly always follows from
them, and of those that tie in these bits the whole digests are compared. So results are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

LANES = 1 << 15  # strings that are hashed at once: few enough for a core's cache, enough to outweigh each call
BLOCK = 1 << 16  # different strings of the texts that are looked at together
FEW = 512  # strings of one number of md5 blocks that are left to hashlib

_CONSTANT = [np.array(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF, np.uint32) for i in range(64)]
_LEFT = [np.array(n, np.uint32) for n in [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]]
_RIGHT = [np.array(32 - n, np.uint32) for n in _LEFT]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(state: list, words: list, f: np.ndarray, t: np.ndarray, steps: int = 64) -> tuple:
    """The registers after ``steps`` steps, and a free array. words: the block's 16 words, None where all are zero. state is overwritten."""
    xor, both, either, negate, add, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.invert, np.add, np.left_shift, np.right_shift
    a, b, c, d = state
    for i in range(steps):
        if i < 16:
            xor(c, d, f)
            both(f, b, f)
            xor(f, d, f)
        elif i < 32:
            xor(b, c, f)
            both(f, d, f)
            xor(f, c, f)
        elif i < 48:
            xor(b, c, f)
            xor(f, d, f)
        else:
            negate(d, f)
            either(f, b, f)
            xor(f, c, f)
        add(f, a, f)
        if words[_WORD[i]] is not None:
            add(f, words[_WORD[i]], f)
        add(f, _CONSTANT[i], f)
        right(f, _RIGHT[i], t)
        left(f, _LEFT[i], f)
        either(f, t, f)
        add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return a, b, c, d, f


def _first_words(message: np.ndarray, prefixes: list[bytes], out: np.ndarray) -> None:
    """out[k]: the first 32 bits, as a number that orders like the hex digits, of md5(prefixes[k] + string) for each string.

    message: padded messages (rows of whole md5 blocks) that leave the first bytes, as many as each prefix has, zero.
    """
    n, blocks = len(message), message.shape[1] // 64
    columns = np.ascontiguousarray(message.view("<u4").T)
    held = [[c if c.any() else None for c in columns[16 * b : 16 * b + 16]] for b in range(blocks)]
    headed = -(-len(prefixes[0]) // 4)  # words that the prefix reaches
    heads = [np.empty(n, np.uint32) for _ in range(headed)]
    room = [np.empty(n, np.uint32) for _ in range(6)]
    for k, prefix in enumerate(prefixes):
        value = np.frombuffer(prefix.ljust(4 * headed, b"\0"), "<u4")
        words = [*(np.add(columns[w], value[w], heads[w]) for w in range(headed)), *held[0][headed:]]
        before = list(_START)
        for b in range(blocks):
            state, last = room[:4], b == blocks - 1
            for x, v in zip(state, before, strict=True):
                x[:] = v
            got = _rounds(state, words if b == 0 else held[b], room[4], room[5], 61 if last else 64)
            if last:
                np.add(got[1], before[0], out[k])  # the first register is not changed by the last three steps
            else:
                before = [x + np.asarray(v, np.uint32) for x, v in zip(got[:4], before, strict=True)]
            room = [*got, room[5]]
        out[k].byteswap(inplace=True)


def first_words(strings: list[bytes], prefixes: list[bytes]) -> np.ndarray:
    """The first 32 bits of md5(prefix + string), prefixes by strings. Prefixes of one length should stand together."""
    out = np.empty((len(prefixes), len(strings)), np.uint32)
    sizes = np.array([len(s) for s in strings], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    at = 0
    for length, alike in groupby(prefixes, len):
        heads = list(alike)
        blocks = (length + sizes + 8) // 64 + 1
        edges = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)])).tolist() if len(blocks) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < FEW:
                for i in order[lo:hi].tolist():
                    out[at : at + len(heads), i] = [int.from_bytes(hashlib.md5(h + strings[i]).digest()[:4]) for h in heads]
                continue
            width = 64 * int(blocks[lo])
            for a in range(lo, hi, LANES):
                picked = order[a : min(a + LANES, hi)]
                message = np.frombuffer(bytearray().join([(b"\0" * length + strings[i] + b"\x80").ljust(width, b"\0") for i in picked.tolist()]), np.uint8).reshape(-1, width)
                message[:, -8:] = (8 * (length + sizes[a : a + len(picked)])).astype("<u8").view(np.uint8).reshape(-1, 8)
                part = np.empty((len(heads), len(picked)), np.uint32)
                _first_words(message, heads, part)
                out[at : at + len(heads), picked] = part
        at += len(heads)
    return out


def shingles(text: bytes, k: int) -> list[bytes]:
    """Distinct runs of k words of a normalised text (words with one space between); the whole text if there are fewer."""
    starts = [0, *(np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1).tolist()]
    if len(starts) < k or not text:
        return [text]
    ends = [*(s - 1 for s in starts[k:]), len(text)]
    return list(dict.fromkeys([text[a:b] for a, b in zip(starts, ends, strict=False)]))


def smallest(sets: list[list[bytes]], prefixes: list[bytes]) -> np.ndarray:
    """The smallest digest of each set (none empty) for each prefix: sets by prefixes by 16 bytes."""
    number: dict[bytes, int] = {}
    index = np.array([number.setdefault(s, len(number)) for one in sets for s in one], np.int64)
    strings = list(number)
    edges = np.cumsum([0, *map(len, sets)])
    row = np.repeat(np.arange(len(sets)), np.diff(edges))
    words = first_words(strings, prefixes)
    digests = np.empty((len(sets), len(prefixes), 16), np.uint8)
    for k, prefix in enumerate(prefixes):
        own = words[k][index]
        hit = np.flatnonzero(own == np.minimum.reduceat(own, edges[:-1])[row])
        found: list[bytes] = [b""] * len(sets)
        for r, i in zip(row[hit].tolist(), index[hit].tolist(), strict=True):
            digest = hashlib.md5(prefix + strings[i]).digest()
            if not found[r] or digest < found[r]:
                found[r] = digest
        digests[:, k] = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
    return digests


_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _rows(ids: pa.Array, digests: np.ndarray, digits: int, counts: np.ndarray) -> pa.RecordBatch:
    """idx, signature, shingles: the first ``digits`` hex digits of digests (rows by prefixes by 16 bytes), and how many shingles there are."""
    rows, n = len(ids), digests.shape[0] * digests.shape[1]
    text = _HEX[digests[:, :, : digits // 2]].reshape(-1)
    values = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(digits)), pa.py_buffer(text))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(digests.shape[1])), values)
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(counts.astype(np.int32))], ["idx", "signature", "shingles"])


def unpacked(prefixes: int, digits: int):
    """For mapInArrow: (idx, signature, shingles) of (idx, digests), as Minima.java gives them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, 16 * prefixes + 4)
                yield _rows(part.column(0), rows[:, :-4].reshape(-1, prefixes, 16), digits, np.ascontiguousarray(rows[:, -4:]).view(">i4")[:, 0])

    return run


def signed(prefixes: list[bytes], k: int, digits: int):
    """For mapInArrow: (idx, signature, shingles) of (idx, normalised text); the first ``digits`` hex digits of each digest. Null texts give no row."""
    def flush(ids: list, kind: pa.DataType, sets: list[list[bytes]]) -> pa.RecordBatch:
        return _rows(pa.array(ids, kind), smallest(sets, prefixes), digits, np.array([len(x) for x in sets]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sets: list[list[bytes]] = []
        held, kind = 0, None
        for batch in batches:
            kind = batch.schema.types[0]
            for idx, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if text.is_valid:
                    ids.append(idx)
                    sets.append(shingles(text.as_py(), k))
                    held += len(sets[-1])
                if held >= BLOCK or len(ids) >= BLOCK // 8:
                    yield flush(ids, kind, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, kind, sets)

    return run
