"""All queries of the review engine and their SQL oracles."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
