"""All registered queries and their SQL."""

from __future__ import annotations

from . import feature_queries, index_queries, ranking_queries, source_queries, status_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
