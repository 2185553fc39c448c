"""Queries of the engine, by name, with their SQL."""

from . import queries_collections, queries_dataset, queries_features  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
