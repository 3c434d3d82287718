"""op1 and op6: exact round trips against the tokenizer itself; the curve's properties."""

import glob
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm import packing, tokens
from lexiforge.llm.words import blocks


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, hard, tokenizer_path, tmp_path):
    folder = f"{tmp_path}/tokens"
    tokens.write_token_files(hard, folder, tokenizer_path)
    hashed = hard.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = [(r.doc_id, r.text) for r in sorted(hashed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    want, at = [], 0
    for i, text in rows:
        ids = ids_of(tokenizer_path, text)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in tokens.token_digests(spark, folder).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    back = {(r.doc_id, r.start): r.ids for r in tokens.read_tokens(spark, folder).collect()}
    assert all(crc(back[i, s]) == c for i, s, _, c in want)
    plan = tokens.read_tokens(spark, folder).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_token_files_of_nothing(spark, empty, tokenizer_path, tmp_path):
    tokens.write_token_files(empty, f"{tmp_path}/t", tokenizer_path)
    assert tokens.token_digests(spark, f"{tmp_path}/t").count() == 0


def morse(a, b):
    """Two long words that agree in every sum of their bytes by powers modulo 2**64."""
    w = a
    for _ in range(10):
        w += w.translate(str.maketrans(a + b, b + a))
    return w


def test_encoder_is_exact(tokenizer_path):
    coder, t = tokens.Encoder(tokenizer_path, slots=64, store=512, long_parts=8), Tokenizer.from_file(tokenizer_path)
    r = random.Random(1)
    letters = [*" \n\t  aab'st\u00e9 \u3000 \u2002\r\x0b\x1c1.!\u00a0\x00", "<|endoftext|>", " there", "ing and"]
    texts = [morse("a", "b"), morse("b", "a"), "a <|endoftext|> b", *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000))]
    for block in blocks(pa.array(texts), 3000):
        flat, n = coder.encode_block(block)
        for i, ids in enumerate(np.split(flat, np.cumsum(n)[:-1]), block.first):
            assert ids.tolist() == [*t.encode(texts[i], add_special_tokens=False).ids, 0]


def test_a_very_long_text_is_encoded_in_pieces(tokenizer_path, monkeypatch):
    monkeypatch.setattr(tokens, "ENCODE_BYTES", 1000)
    text = " ".join(f"w{i}  x\n\n{i} \u00e9\u3000 ok <|endoftext|>" for i in range(2000))
    block = next(blocks(pa.array([text])))
    flat, n = tokens.Encoder(tokenizer_path).encode_block(block)
    assert flat.tolist() == ids_of(tokenizer_path, text) and n.tolist() == [len(flat)]


def test_memory_of_a_very_long_text(tokenizer_path):
    code = f"""
import resource, numpy as np, pyarrow as pa
from lexiforge.llm import tokens, words
coder = tokens.Encoder({tokenizer_path!r})
text = "some words of a long text and more\\n" * (50_000_000 // 35)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
flat, n = coder.encode_block(next(words.blocks(pa.array([text]))))
assert n[0] == len(flat) > 10_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout)
    assert grown < 300  # MB: the ids, twice, and the text


def test_layout_of_token_files(spark, tokenizer_path, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.repeat(F.concat(F.lit(" number "), F.col("id").cast("string")), 40)).alias("text"))
    tokens.write_token_files(docs.coalesce(1), f"{tmp_path}/t", tokenizer_path, row_group_bytes=1 << 16, page_bytes=1 << 12, page_rows=100)
    groups = 0
    for path in glob.glob(f"{tmp_path}/t/tokens/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and (column.has_column_index or column.path_in_schema.startswith("ids"))
                if column.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in column.encodings
                elif column.path_in_schema != "shard":
                    assert "DELTA_BINARY_PACKED" in column.encodings
    assert groups > 1
    one = spark.read.parquet(f"{tmp_path}/t/tokens").where("doc_id = 1234").select("doc_id", "n_tokens")
    assert [r.doc_id for r in one.collect()] == [1234]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() <= 200  # the other pages were skipped


def test_packing(spark, hard, empty, tokenizer_path):
    rows = packing.pack_documents(hard, tokenizer_path, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(sum(n for _, n in p) < 1024 for p in sequences.values()) <= 4  # one a range at most
    texts = sorted(tuple(ids_of(tokenizer_path, r.text)) for r in hard.collect())
    pieces = defaultdict(dict)
    order = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    whole, current = [], []
    for r in order:
        current += r.ids
        pieces[r.doc_id][r.start] = r.length
        if r.start + r.length == r.doc_tokens:
            whole.append(tuple(current))
            current = []
    assert sorted(whole) == texts and not current
    assert packing.pack_documents(empty, tokenizer_path).count() == 0


def test_curve_is_a_curve():
    side = 1 << 3
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(points, bits=3)
    assert sorted(key.tolist()) == list(range(side**3))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_are_neighbours(spark, tokenizer_path):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("topic"), (F.col("id") % 3).cast("string"), F.lit(" words of it"), F.lit("")).alias("text"))
    rows = packing.pack_documents(docs.coalesce(1), tokenizer_path).collect()
    keys = {r.doc_id % 3: set() for r in rows}
    for r in rows:
        keys[r.doc_id % 3].add(r.curve_key)
    assert all(len(k) == 1 for k in keys.values())
