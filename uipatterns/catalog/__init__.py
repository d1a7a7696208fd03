"""Registered queries and their equivalent SQL."""

from uipatterns.catalog import q_data, q_metrics, q_pages, q_scoring, q_sources, q_traces  # noqa: F401
from uipatterns.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
