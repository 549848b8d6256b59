"""Named queries over the operators."""

from . import editorial_queries, graph_queries, state_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "editorial_queries", "graph_queries", "state_queries", "text_queries"]
