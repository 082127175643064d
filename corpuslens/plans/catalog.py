"""Imports every query module, so the registry is complete."""

from corpuslens.plans import corpus_queries, evaluation_queries, evidence_queries, metric_queries, order_queries, retrieval_queries, streaming_queries, table_queries  # noqa: F401
from corpuslens.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
