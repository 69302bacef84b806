"""Queries over the given tables. Importing the modules registers them."""

from . import file_queries, metric_queries, raster_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
