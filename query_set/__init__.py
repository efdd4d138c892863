"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import aggregates, features, ingest, joins, labels, statistics  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
