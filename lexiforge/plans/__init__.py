"""Registered queries of the retrieval pipeline."""

from lexiforge.plans import dedup_queries, search_queries, structure_queries, text_queries  # noqa: F401
from lexiforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
