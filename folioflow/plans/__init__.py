"""The registered queries over single pages and over document order."""

from folioflow.plans import book_queries, page_queries, review_queries  # noqa: F401
from folioflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
