"""All registered queries of the library proper."""

from . import context_queries, detail_queries, json_queries, listing_queries, more_queries, retrieval_queries, stats_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
