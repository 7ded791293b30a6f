"""All registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import context, decisions, ledgers, techniques  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "cache_cost_by_strategy"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
