"""Row predicates of the metrics (F-01 … F-14) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.time import days_interval
from cadence.functions.util import as_col


def since(ts, anchor, days: int) -> Column:
    """``ts >= anchor - days`` (F-01 / F-02); inclusive."""
    return as_col(ts) >= as_col(anchor) - days_interval(days)


def within(ts, anchor, days: int) -> Column:
    """``anchor - days <= ts <= anchor`` (F-03 / F-04)."""
    ts = as_col(ts)
    return (ts >= as_col(anchor) - days_interval(days)) & (ts <= as_col(anchor))


def not_in(c, values) -> Column:
    """``c NOT IN (...)``: NULL is neither in nor out, so the row is dropped (F-05, F-07)."""
    return ~as_col(c).isin(list(values))


def not_draft(c="draft") -> Column:
    """``draft IS NULL OR draft = 0`` (F-06)."""
    c = as_col(c)
    return c.isNull() | (c == 0)


def trimmed_eq(c, value: str) -> Column:
    """``TRIM(c) = value`` (F-09); both engines strip blanks only."""
    return F.trim(as_col(c)) == F.lit(value)


def trimmed_in(c, values) -> Column:
    return F.trim(as_col(c)).isin(list(values))


def not_relative_path(c) -> Column:
    """``c NOT LIKE './%' AND c NOT LIKE '../%'`` (F-10)."""
    c = as_col(c)
    return ~c.startswith("./") & ~c.startswith("../")


def non_empty(c) -> Column:
    """``c IS NOT NULL AND c != ''`` (F-13)."""
    c = as_col(c)
    return c.isNotNull() & (c != F.lit(""))


def tracker_closed(is_closed="is_closed", closed_at="closed_at") -> Column:
    """``is_closed = 'true' OR closed_at IS NOT NULL`` (F-14)."""
    return (as_col(is_closed) == F.lit("true")) | as_col(closed_at).isNotNull()
