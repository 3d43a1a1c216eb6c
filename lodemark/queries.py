"""All queries of the library by name, with their SQL twins."""

from __future__ import annotations

from .plans import extras, market, news, reports, risk, sentiment, signal_plans, text_plans  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
