"""Packing along a space-filling curve: neighbours in content become neighbours in a sequence.

Each text gets a vector of hashed word features projected to four dimensions; its Hilbert key orders the corpus.
One range exchange by that key deals the texts, each task tokenises its range in curve order, lays the ids end to
end and cuts every ``length`` ids. Only the last sequence of a range is shorter, so padding is at most one partial
sequence a range. Ranges split groups of one key by doc_id and a hash of the text, so a large group of equal texts still
spreads over tasks.

Null text is empty (its end id is packed); rows that share a doc_id are packed each; ties of the key go by doc_id, then the
text's hash. A very long text is encoded in pieces. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.shared import arrow_map, by_ranges, plan_bytes
from lexiforge.llm.tokens import ENCODE_BYTES, encoder
from lexiforge.llm.words import blocks, hashes, words

DIMS, BITS = 4, 12


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of unsigned integer points, one row a point, each coordinate below 2**bits.

    Gray-code form: undo the rotations and reflections from the highest bit down, then read the bits across.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows' points in DIMS dimensions: each word hash is a pseudo-random direction, a row is the scaled mean of its words'."""
    counts = np.diff(first)
    out = np.full((len(counts), DIMS), 1 << (BITS - 1), np.int64)
    full = counts > 0
    if full.any():
        for k in range(DIMS):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum((h >> np.uint64(16 * k)) & np.uint64(0xFFFF), out=total[1:])
            mean = (total[first[1:]] - total[first[:-1]])[full] / counts[full] / 32768.0 - 1.0
            out[full, k] = np.clip((0.5 + np.arctan(6.0 * mean) / np.pi) * (1 << BITS), 0, (1 << BITS) - 1)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.zeros(0, np.int64)]
        for block in blocks(batch.column(1)):
            w = words(block)
            keys.append(hilbert_key(project(hashes(block, w, lower=True), w.first)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys))], ["doc_id", "text", "curve_key"])


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("curve_key", pa.int64())]


def _pack(path: str, length: int, with_ids: bool):
    schema = pa.schema([*_PIECE, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, base = encoder(path), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(2).to_numpy()
            doc_ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1), ENCODE_BYTES):
                flat, counts = coder.encode_block(block)
                view, begin = memoryview(flat.astype("<i4", copy=False)).cast("B"), 0
                rows: list[list] = [[] for _ in schema.names]
                for i, n in enumerate(counts.tolist(), block.first):
                    start = 0
                    while start < n:
                        size = min(n - start, length - at % length)
                        lo = begin + start
                        values = [doc_ids[i], start, size, zlib.crc32(view[4 * lo : 4 * (lo + size)]), n, base + at // length, at % length, int(keys[i])]
                        if with_ids:
                            values.append(flat[lo : lo + size])
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                        start += size
                        at += size
                    begin += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most ``length`` ids, in curve order.

    doc_id, start (ids of its document before the piece), length, ids_crc32, doc_tokens, sequence_id, offset,
    curve_key, and the ids themselves if asked for. The high bits of sequence_id are the range's number on the curve.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = arrow_map(texts, _keys, "doc_id long, text string, curve_key long")
    ordered = by_ranges(keyed.withColumn("_h", F.xxhash64("text")), plan_bytes(docs), "curve_key", "doc_id", "_h").select("doc_id", "text", "curve_key")
    columns = ", ".join(f"{n} long" for n, _ in _PIECE) + (", ids array<int>" if with_ids else "")
    return arrow_map(ordered, _pack(tokenizer_path, length, with_ids), columns)
