"""All named queries; importing the modules registers them."""

from . import evaluation_queries, event_queries, product_tools, resolution, review_queries, sql_tools, stream_queries, text_queries, tools, upkeep
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "evaluation_queries", "event_queries", "product_tools", "resolution", "review_queries", "sql_tools", "stream_queries", "text_queries", "tools", "upkeep"]
