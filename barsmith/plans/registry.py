"""All queries over the driver's tables, with the SQL that each is held against."""

from __future__ import annotations

from barsmith.plans import books, classification, evaluation, factors, features, markets, paths, regimes, relational, research, resampling, screener, screening, serving, signals, statistics, streams, timeline  # noqa: F401
from barsmith.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "a9_v8_trade_outcomes"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
