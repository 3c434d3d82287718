"""Schemas of the pipeline's tables, declared once."""

from __future__ import annotations

from pyspark.sql import types as T


_BASIC = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BINARY": T.BinaryType()}


def _kind(text: str) -> T.DataType:
    return T.ArrayType(_kind(text[6:-1])) if text.startswith("ARRAY<") else _BASIC[text]


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _kind(kind)) for name, kind in (f.strip().split(" ") for f in text.split(","))])


FILE = _struct("path STRING, suffix STRING, length BIGINT, content BINARY")
PAGE = _struct("path STRING, page_id INT, text STRING")
ELEMENT = _struct("path STRING, ord INT, element_type STRING, content STRING, page_number INT, section STRING, level INT")
CHUNK = _struct("idx BIGINT, text STRING, pages ARRAY<INT>, page_start INT, page_end INT, section STRING, source STRING, source_path STRING, chunk_id STRING, char_count INT, word_count INT, keywords ARRAY<STRING>, keywords_lower ARRAY<STRING>, phrases ARRAY<STRING>, vendor STRING, version STRING, release INT, doc_type STRING, topics ARRAY<STRING>")
POSTING = _struct("index_name STRING, term STRING, idx BIGINT")
EDGE = _struct("idx BIGINT, ord INT, neighbour BIGINT")
VECTOR = _struct("idx BIGINT, embedding ARRAY<FLOAT>")
RESULT = _struct("query_id INT, idx BIGINT, rank INT, score DOUBLE, type STRING")
TURN = _struct("conv_id BIGINT, turn BIGINT, role STRING, text STRING")
IMAGE = _struct("path STRING, index INT, page INT, width INT, height INT, format STRING, ocr_text STRING, caption STRING, alt_text STRING, hash STRING")
TABLE = _struct("path STRING, index INT, page INT, caption STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>")
#: A vector store's row; longer text, section and title are cut to these lengths.
STORED = _struct("id BIGINT, embedding ARRAY<FLOAT>, text STRING, chunk_id STRING, source STRING, page_start INT, page_end INT, section STRING, vendor STRING, chunk_type STRING, doc_title STRING")
STORED_LIMITS = {"text": 65000, "section": 500, "doc_title": 500}
