"""Registered queries."""

from . import core, extra, more, rest, single
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "core", "extra", "more", "rest", "single"]
