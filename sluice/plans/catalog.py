"""The registry of queries over the driver's tables."""

from __future__ import annotations

from . import archives, more, signals, spaces, sweeps  # noqa: F401  register their queries
from .adapters import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
