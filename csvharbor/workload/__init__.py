"""Queries over the given tables, one or more per operator, with SQL that gives the same result."""

from csvharbor.workload import audit, cells, changes, explore, files, history, keys, mapping, publishing, sides, surface, validation  # noqa: F401
from csvharbor.workload.base import QUERIES, Query

__all__ = ["QUERIES", "Query"]
