"""The registered queries: each a DataFrame job over the given tables, most with a SQL twin."""

from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
