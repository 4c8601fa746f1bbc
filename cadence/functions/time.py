"""Time expressions on TIMESTAMP_NTZ columns (time-zone independent)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.util import as_col

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def elapsed_seconds(start, end) -> Column:
    """Seconds from ``start`` to ``end`` as DOUBLE, exact to the microsecond.

    ``timestamp_diff`` on NTZ values does not consult the session zone, so a
    daylight-saving change cannot shift the result (casting to TIMESTAMP does).
    """
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end)) / F.lit(1_000_000.0)


def elapsed(start, end, unit: str = "day") -> Column:
    """Elapsed time in days / hours / minutes / seconds (P-01)."""
    return elapsed_seconds(start, end) / F.lit(float(SECONDS[unit]))


def to_day(ts) -> Column:
    """Calendar day of a timestamp (P-02)."""
    return F.to_date(as_col(ts))


def to_week(ts) -> Column:
    """Monday of the ISO week containing ``ts``, as DATE (P-03)."""
    return F.trunc(F.to_date(as_col(ts)), "week")


def to_month_text(ts) -> Column:
    """'yyyy-MM' text of a timestamp (P-04)."""
    return F.date_format(as_col(ts), "yyyy-MM")


def to_date_text(ts) -> Column:
    """'yyyy-MM-dd' text of a timestamp (P-22)."""
    return F.date_format(as_col(ts), "yyyy-MM-dd")


def use_weeks(days: int, switch: int) -> bool:
    """Grain switch decided before planning (P-05): week grain from ``switch`` days."""
    return days >= switch


def to_grain(ts, days: int, switch: int) -> Column:
    return to_week(ts) if use_weeks(days, switch) else to_day(ts)


def days_interval(days: int) -> Column:
    return F.make_dt_interval(F.lit(int(days)))


def lit_ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime / ISO text."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
