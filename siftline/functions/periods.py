"""Reporting periods: inclusive pairs of dates in UTC."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Analytics rows end yesterday; search rows end three days ago.
LAG_DAYS = {"ga4": 1, "gsc": 3}


def acquisition_periods(days: int, now: date) -> dict[str, dict[str, tuple[date, date]]]:
    """For each source: the current period and the equal one before it."""
    if not isinstance(days, int) or isinstance(days, bool) or not 1 <= days <= 366:
        raise ValueError("days must be a whole number from 1 to 366")
    out = {}
    for source, lag in LAG_DAYS.items():
        end = now - timedelta(days=lag)
        start = end - timedelta(days=days - 1)
        out[source] = {"current": (start, end), "previous": (start - timedelta(days=days), start - timedelta(days=1))}
    return out


def period_of(day: Column, periods: dict[str, tuple[date, date]]) -> Column:
    """current, previous or null. The bounds compare with the raw column, so partition and row-group pruning see them."""
    out = None
    for name, (start, end) in periods.items():
        inside = (day >= F.lit(start)) & (day <= F.lit(end))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def length_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1
