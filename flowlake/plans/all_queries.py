"""All registered queries of the log engine."""

from . import ingest_queries, lifecycle_queries, profile_queries, search_queries  # noqa: F401  they register themselves
from .registered import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
