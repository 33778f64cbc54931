"""The library's own queries; importing this module registers them."""

from . import report_queries, text_queries, topic_queries  # noqa: F401
from .registry import ORACLE, QUERIES

FLAGSHIP = "flagship_topics"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
