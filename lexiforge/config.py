"""Constants of the four generations of the retrieval pipeline, as one frozen record each."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 2000
    chunk_overlap: int = 300
    max_chunk: int = 3000
    min_chunk: int = 100
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    similarity: float = 0.92
    embedding_dim: int = 1024
    semantic_k: int = 40
    final_k: int = 12
    bm25_k: int = 40
    weights: tuple[float, float, float] = (0.40, 0.30, 0.30)  # semantic, BM25, keyword
    rerank_mix: tuple[float, float] = (0.3, 0.7)
    header_lines: int = 30
    first_section: str = "Introduction"
    exact_boost: float = 3.0
    postings_limit: int = 30
    context_tokens: int = 6000


V2 = Settings()
V1 = Settings(chunk_size=5000, chunk_overlap=600, embedding_dim=768, semantic_k=20, final_k=5, rerank_mix=(0.4, 0.6))
V1_SECTIONS = Settings(chunk_size=5000, chunk_overlap=600, max_chunk=8000, similarity=0.85, embedding_dim=768, header_lines=20, first_section="Document Start")
V1_OPTIMISED = Settings(chunk_size=6000, chunk_overlap=800, max_chunk=12000, bm25_b=0.80, similarity=0.85, semantic_k=12, final_k=8, bm25_k=30, weights=(0.50, 0.35, 0.15), rerank_mix=(0.35, 0.65), header_lines=20, first_section="Document Start", postings_limit=20)

#: Named weight presets: semantic, BM25, keyword.
PRESETS = {"balanced": (0.40, 0.30, 0.30), "semantic": (0.60, 0.25, 0.15), "bm25": (0.25, 0.45, 0.30), "keyword": (0.30, 0.30, 0.40)}
PRESETS_OPTIMISED = {"balanced": (0.50, 0.35, 0.15), "semantic": (0.70, 0.20, 0.10), "exact": (0.30, 0.50, 0.20), "ids": (0.20, 0.40, 0.40)}
