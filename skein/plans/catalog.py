"""All registered queries of the core library and their SQL."""

from skein.plans import loads, queries, searches
from skein.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "loads", "queries", "searches"]
