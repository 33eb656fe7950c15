"""Registered queries: each operator over the given tables, next to equal SQL for a second engine."""

from __future__ import annotations

from . import compare, fields, joins, metrics, prep, quality, reshape, sources, spatial  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
