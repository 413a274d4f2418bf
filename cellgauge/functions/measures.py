"""Measures shared by KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Points off a tower's score per percent, and per critical alarm.
PENALTIES = {"network_failure_rate": 1.5, "dropped_call_rate": 2.0, "failed_session_rate": 1.5, "critical_alarms": 5.0}


def safe_rate(part: str | Column, whole: str | Column) -> Column:
    """Percent to three places; 0 where there is no whole."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole > 0, F.round(part / whole * 100, 3)).otherwise(F.lit(0.0))


def health_score() -> Column:
    lost = reduce(Column.__add__, [F.col(c) * w for c, w in PENALTIES.items()])
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) - lost, 3))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def megabytes(size: Column) -> Column:
    return F.round(size / (1024 * 1024), 3)
