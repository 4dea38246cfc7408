"""All queries of the core, and their SQL."""

from __future__ import annotations

from marginalia.plans import reads, relations, texts  # noqa: F401
from marginalia.plans.base import ORACLE, QUERIES

FLAGSHIP = "flagship"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
