"""Registered queries and their SQL counterparts."""

from . import site_queries, state_queries, text_queries, tree_queries, url_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "site_queries", "state_queries", "text_queries", "tree_queries", "url_queries"]
