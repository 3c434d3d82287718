"""Models as interfaces: an encoder, a pair scorer, a generator. Each is wrapped once as a vectorised function.

Nothing here holds a model; tests and queries use deterministic stand-ins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiforge.session import ship


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score_pairs(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


class HashedEncoder:
    """A stand-in: words hashed to signed dimensions."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def embed(rows: DataFrame, make_encoder: Callable[[], Encoder], text: str = "text", batch: int = 64) -> DataFrame:
    """rows with embedding, of unit length. The encoder is made once a task and sees ``batch`` texts at a time."""
    names = [c for c in rows.columns if c != "embedding"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            made = [v for at in range(0, len(frame), batch) for v in unit(encoder.encode(frame[text].fillna("").tolist()[at : at + batch]))]
            yield frame.assign(embedding=made)

    ship(rows.sparkSession)
    return rows.select(*names).mapInPandas(run, schema)


def pair_scores(query: Column, text: Column, make_scorer: Callable[[], PairScorer], cut: int = 1500) -> Column:
    """A re-ranker's score of each pair; the text is cut to its first characters."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for q, t in batches:
            yield pd.Series(scorer.score_pairs(list(zip(q, t, strict=True))), dtype="float64")

    return score(query, F.substring(text, 1, cut))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; not the edit distance."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def fuzzy_keywords(index: DataFrame, terms: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, term, keyword, ratio of index terms that are like a query's terms; lengths that cannot reach the threshold are not compared.

    terms (query_id, term) is the stated query batch.
    """
    ship(index.sparkSession)
    vocabulary = index.select(F.col("term").alias("keyword")).distinct()
    near = 2 * F.least(F.length("keyword"), F.length("term")) >= threshold * (F.length("keyword") + F.length("term"))
    pairs = vocabulary.join(F.broadcast(terms), near)
    return pairs.withColumn("ratio", fuzzy_ratio(F.col("term"), F.col("keyword"))).where(F.col("ratio") >= threshold).select("query_id", "term", "keyword", "ratio")


def generate(prompts: DataFrame, make_generator: Callable[[], Generator]) -> DataFrame:
    """query_id, answer for prompts (query_id, system, prompt); an error becomes a null answer with its message."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_generator()
        for frame in frames:
            rows = []
            for q, s, p in zip(frame["query_id"], frame["system"], frame["prompt"], strict=True):
                try:
                    rows.append((q, model.generate(s, p), None))
                except Exception as e:
                    rows.append((q, None, str(e)))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "error"])

    ship(prompts.sparkSession)
    return prompts.select("query_id", "system", "prompt").mapInPandas(run, "query_id int, answer string, error string")


def average_hash(pixels: np.ndarray) -> str:
    """32 hex digits of a 16 x 16 grey image: a bit for each pixel above the mean, cut to the first half."""
    bits = "".join("1" if p > pixels.mean() else "0" for p in pixels.ravel())
    return format(int(bits, 2), "064x")[:32]


def image_hashes(images: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """path, hash of images (path, content); ``decode`` gives the 16 x 16 grey pixels."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "hash": [average_hash(decode(bytes(c))) for c in frame["content"]]})

    ship(images.sparkSession)
    return images.select("path", "content").mapInPandas(run, "path string, hash string")


def store_vectors(rows: DataFrame, open_store: Callable[[], Callable[[list[dict]], None]], batch: int = 1000) -> None:
    """Hands rows to an external vector store by partition, in batches; ``open_store`` connects and returns the insert function."""
    def send(partition: Iterator) -> None:
        insert, held = open_store(), []
        for row in partition:
            held.append(row.asDict())
            if len(held) == batch:
                insert(held)
                held = []
        if held:
            insert(held)

    rows.foreachPartition(send)
