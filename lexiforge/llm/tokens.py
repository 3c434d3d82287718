"""Token files: ids of whole texts as Parquet list columns that can be read by column, row group and page.

Layout of a token folder: ``tokens/`` holds one file for each range of doc_id with the columns
``shard, doc_id, local_start, n_tokens, ids``; ids are dictionary-encoded, the others delta-encoded
(Parquet 2 pages), row groups and pages have set sizes and pages carry indexes. ``index/`` holds one row a shard.
A reader of metadata never touches the ids, a reader of some documents skips by page.

Ids are those of the tokenizers library for the whole text, special tokens written in it included. Null text is empty; an
empty text has the end id alone. Rows that share a doc_id are all kept, in an order set by a hash of their text. A very
long text is encoded in pieces. An empty table gives an empty folder with the same schema. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.shared import arrow_map, by_ranges, materialise, plan_bytes
from lexiforge.llm.words import _FIRST_BYTES, Block, blocks, eights, mix

END_ID = 0
ENCODE_BYTES = 1 << 19  # texts encoded at once
SHORT = 16  # bytes of a part that are its key in the table

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True  # before these a text may be cut
_OPEN = np.zeros(256, bool)
_OPEN[33:127] = True  # bytes that are surely no white space
_CUT = re.compile(rb"(?<=[!-~])[\t\n\r ]")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE by the tokenizers library, remembering the ids of parts.

    Where white space follows another character, a byte-level pre-tokenizer always begins a new piece, so a text is the
    sum of its parts: white space with what follows it up to the next cut. Parts are looked up without a Python loop in a
    direct-mapped table of fixed size whose keys are the parts' bytes themselves, longer ones in a dict; those not found
    are encoded by the library, many in one call. A tokenizer of another build gets whole texts.
    """

    def __init__(self, path: str, slots: int = 1 << 20, store: int = 1 << 22, long_parts: int = 1 << 16) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        built = json.loads(self.tokenizer.to_str())
        pre = built["pre_tokenizer"] or {}
        plain = [t for t in built["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]))]
        self.cuts = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not built["normalizer"] and plain == built["added_tokens"]
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = piece.startswith("\u0120")  # how byte-level vocabularies write a space
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.slots, self.room, self.long_parts = slots, store, long_parts
        self._forget()

    def _forget(self) -> None:
        self.low, self.high, self.size = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint8)
        self.at, self.n = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.store = np.full(self.room, END_ID, self.kind)
        self.used = 1  # the end id stands at 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> int:
        """Appends to the store, which grows for a piece if it must and is emptied between pieces."""
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(ids), len(self.store) // 2), self.kind)])
        at = self.used
        self.store[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of these parts stand, and how many."""
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        # one space and no other: in a row of such parts an id that begins with a space begins a part
        spaces = np.concatenate(([0], np.cumsum(data == 32)))
        simple = (data[starts] == 32) & (spaces[ends] - spaces[starts] == 1)
        alone = np.flatnonzero(~simple).tolist()
        after = np.flatnonzero(simple)
        for lo in range(0, len(after), 1000):
            some = after[lo : lo + 1000]
            sizes = ends[some] - starts[some]
            edges = np.cumsum(sizes) - sizes
            joined = data[np.arange(int(sizes.sum())) + np.repeat(starts[some] - edges, sizes)].tobytes().decode()
            ids = np.array(self._encode([joined])[0], self.kind)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(some):
                at[some] = self._keep(ids) + first
                n[some] = np.diff(np.append(first, len(ids)))
            else:  # special tokens may do this
                alone += some.tolist()
        texts = [data[starts[i] : ends[i]].tobytes().decode() for i in alone]
        for i, ids in zip(alone, self._encode(texts), strict=True):
            at[i], n[i] = self._keep(np.array(ids, self.kind)), len(ids)
        return at, n

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the parts, and each text's first (one more at the end)."""
        begins = np.zeros(len(data), bool)
        if self.cuts:
            begins[1:] = _BLANK[data[1:]] & _OPEN[data[:-1]]
            wide = np.flatnonzero(_BLANK[data[1:]] & (data[:-1] >= 0x80)) + 1
            begins[wide[~_white_before(data, wide)]] = True
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(starts, offsets)

    def _encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and how many each text has."""
        if self.used > self.room * 3 // 4 or len(self.long) > self.long_parts:
            self._forget()
        starts, first = self._parts(data, offsets)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        short = np.flatnonzero(size <= SHORT)
        eight = eights(data)
        low = eight[starts[short]] & _FIRST_BYTES[np.minimum(size[short], 8)]
        high = np.zeros(len(short), np.uint64)
        more = np.flatnonzero(size[short] > 8)
        high[more] = eight[starts[short[more]] + 8] & _FIRST_BYTES[size[short[more]] - 8]
        slot = (mix(mix(low + size[short].astype(np.uint64)) ^ high) & np.uint64(self.slots - 1)).astype(np.int64)
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], n[short] = self.at[slot], self.n[slot]
        new = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high) | (self.size[slot] != size[short]))
        if len(new):
            key = np.empty(len(new), [("low", "u8"), ("high", "u8"), ("size", "u1")])
            key["low"], key["high"], key["size"] = low[new], high[new], size[short[new]]
            order = np.lexsort((key["size"], key["high"], key["low"]))
            differs = np.append(True, key[order][1:] != key[order][:-1])
            one = new[order[differs]]
            each = np.empty(len(new), np.int64)
            each[order] = np.cumsum(differs) - 1
            new_at, new_n = self._learn(data, starts[short[one]], ends[short[one]])
            at[short[new]], n[short[new]] = new_at[each], new_n[each]
            for table, values in ((self.low, low[one]), (self.high, high[one]), (self.size, size[short[one]]), (self.at, new_at), (self.n, new_n)):
                table[slot[one]] = values  # of parts that share a slot the last one stays, in every table
        unknown: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(size > SHORT).tolist():
            part = data[starts[i] : ends[i]].tobytes()
            known = self.long.get(part)
            if known:
                at[i], n[i] = known
            else:
                unknown.setdefault(part, []).append(i)
        if unknown:
            one = np.array([places[0] for places in unknown.values()])
            for (part, places), a, m in zip(unknown.items(), *(x.tolist() for x in self._learn(data, starts[one], ends[one])), strict=True):
                at[places], n[places] = a, m
                if len(part) < 1 << 10:
                    self.long[part] = a, m
        at, n = np.insert(at, first[1:], 0), np.insert(n, first[1:], 1)
        total = np.concatenate(([0], np.cumsum(n)))
        flat = self.store[np.arange(total[-1]) + np.repeat(at - total[:-1], n)].astype(np.int32)
        return flat, np.diff(total[first + np.arange(len(offsets))])

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, each text's followed by the end id, and how many each text has."""
        data = block.data
        if len(block) > 1 or len(data) <= 2 * ENCODE_BYTES or not self.cuts:
            return self._encode_piece(data, block.offsets)
        view, parts, at = memoryview(data), [], 0
        while at < len(data):
            cut = _CUT.search(view, min(at + ENCODE_BYTES, len(data)))
            to = cut.start() if cut else len(data)
            parts.append(self._encode_piece(data[at:to], np.array([0, to - at]))[0][: None if to == len(data) else -1])
            at = to
        return np.concatenate(parts), np.array([sum(map(len, parts))])


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character beyond ASCII that ends before these places is white space."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    three = (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    return two | three | (a == 0xE2) & (b == 0x80) & ((c <= 0x8B) | np.isin(c, (0xA8, 0xA9, 0xAF)))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


TOKENS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TOKENS = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"
_SHARD = pa.schema([("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path there."""
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"))


class ShardWriter:
    """One token file. It gets its name when it is whole, so an attempt that is lost leaves nothing that a reader sees."""

    def __init__(self, folder: str, shard: int, row_group_bytes: int, page_bytes: int, page_rows: int) -> None:
        self.files, root = _opened(folder)
        self.temporary, self.name = f"{root}/tokens/_{shard:07d}-{uuid.uuid4().hex}", f"{root}/tokens/shard-{shard:07d}.parquet"
        self.writer = pq.ParquetWriter(
            self.temporary, TOKENS, filesystem=self.files, version="2.6", data_page_version="2.0", compression="zstd", write_page_index=True, data_page_size=page_bytes, max_rows_per_page=page_rows, write_batch_size=page_rows,
            use_dictionary=["ids.list.element"], column_encoding={c: "DELTA_BINARY_PACKED" for c in ("shard", "doc_id", "local_start", "n_tokens")},
        )
        self.bytes, self.held, self.held_bytes = row_group_bytes, [], 0

    def write(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.held_bytes += batch.nbytes
        if self.held_bytes >= self.bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            rows = pa.Table.from_batches(self.held)
            self.writer.write_table(rows, row_group_size=max(1, rows.num_rows))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        self.writer.close()
        self.files.move(self.temporary, self.name)


def _write_shard(path: str, folder: str, *bounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, start, documents, docs = encoder(path), TaskContext.get().partitionId(), 0, 0, []
        writer = None
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1), ENCODE_BYTES):
                writer = writer or ShardWriter(folder, shard, *bounds)
                flat, n = coder.encode_block(block)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                own = ids.slice(block.first, len(n))
                writer.write(pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), own, pa.array(start + ends - n), pa.array(n), lists], schema=TOKENS))
                docs += [x for x in (pc.min(own).as_py(), pc.max(own).as_py()) if x is not None]
                docs = [min(docs), max(docs)] if docs else []
                start += int(ends[-1])
                documents += len(n)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, docs[0] if docs else None, docs[-1] if docs else None, documents, start), _SHARD, strict=True)], schema=_SHARD)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 500) -> None:
    """Encodes docs (doc_id, text) and writes a token folder in ascending doc_id order.

    One range exchange of the texts; each task encodes its range and writes one file, ids never pass through the JVM. Row
    groups, data pages and the rows of a page are bounded by the arguments. folder: an address that pyarrow opens on
    every executor (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    files, root = _opened(folder)
    files.create_dir(f"{root}/tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash keeps texts out of the sample of keys, and lets a range end within the rows of one doc_id
    ordered = by_ranges(texts.withColumn("_h", F.xxhash64("text")), plan_bytes(docs), "doc_id", "_h").select("doc_id", "text")
    schema = "shard int, first_doc long, last_doc long, documents long, tokens long"
    written = arrow_map(ordered, _write_shard(tokenizer_path, folder, row_group_bytes, page_bytes, page_rows), schema)
    totals = materialise(written.repartition(1), "shards")  # one row a file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a token folder; columns that are not asked for are not read."""
    tokens, index = spark.read.schema(_TOKENS).parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/index").select("shard", F.col("start").alias("_base"))
    return tokens.join(index, "shard").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files; the ids stay in the tasks that read them."""
    tokens = spark.read.schema(_TOKENS).parquet(f"{folder}/tokens").select("shard", "doc_id", "local_start", "ids")
    index = spark.read.parquet(f"{folder}/index").select("shard", F.col("start").alias("_base"))
    schema = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    digests = arrow_map(tokens, _digest, schema)
    return digests.join(index, "shard").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
