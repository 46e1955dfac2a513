"""Queries on the check tables, each with its SQL twin."""

from packetloom.catalog import cleaning, learning, ordered, statistics, stored, streams  # noqa: F401
from packetloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
