"""Operators for training-data pipelines; nothing else in the library imports them."""

from csvharbor.llm import queries  # noqa: F401
from csvharbor.llm.registry import QUERIES

__all__ = ["QUERIES"]
