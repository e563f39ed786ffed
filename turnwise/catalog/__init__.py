"""Registered queries over the driver's tables."""

from turnwise.catalog import dialogue, highlights, labels, responses, rounds, storage, votes  # noqa: F401
from turnwise.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
