"""A PySpark-native engine that queries delimited files and Parquet tables as database tables."""

from .plans.engine import Engine
from .plans.query import Query
from .plans.request import execute_request

__all__ = ["Engine", "Query", "execute_request"]
