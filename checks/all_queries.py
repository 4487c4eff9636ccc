"""Import every query module so that its queries are registered."""

from checks import queries_flow, queries_pages, queries_search, queries_sources, queries_store  # noqa: F401
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
