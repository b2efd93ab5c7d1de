"""Queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from sentinela.registry.base import ORACLES, QUERIES
from sentinela.registry import analytics, gold, ingest, observe, quality  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
