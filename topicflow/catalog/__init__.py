"""Registered queries with their SQL counterparts."""

from . import base, groups, ingest, models, report, tables, text, topics  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
