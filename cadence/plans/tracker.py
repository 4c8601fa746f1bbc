"""Request-tracker metrics (no period, no repository: one tracker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import elapsed_seconds, non_empty, pg_initcap, round_half_up, to_day, tracker_closed
from cadence.operators.trend import trend_change_pct, trend_line
from cadence.sources.tables import Tables

DAY = 86400.0


def _req(t: Tables) -> DataFrame:
    return t.need("tracker_requests")


def tracker_opened(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    return _req(t).where(F.col("submitted_at").isNotNull()).agg(F.count(F.lit(1)).alias("opened"))


def tracker_closed_count(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    return _req(t).where(tracker_closed()).agg(F.count(F.lit(1)).alias("closed"))


def tracker_avg_days_to_close(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    r = _req(t).where(tracker_closed() & F.col("closed_at").isNotNull() & F.col("submitted_at").isNotNull())
    return r.agg(round_half_up(F.avg(elapsed_seconds("submitted_at", "closed_at")) / DAY, 2).alias("avg_days_to_close"))


def _daily(t: Tables) -> DataFrame:
    """Requests per submit day with the day ordinal (W-01). The window runs over
    the daily aggregate — one row per day — so one partition is enough."""
    daily = _req(t).where(F.col("submitted_at").isNotNull()).groupBy(
        to_day("submitted_at").alias("request_date")
    ).agg(F.count(F.lit(1)).alias("actual_requests"))
    return daily.withColumn("day_number", F.row_number().over(Window.orderBy("request_date")))


def tracker_trend_pct(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Percent change along the fitted line between the first and last day that
    have requests; NULL when fewer than two days or the first value is 0 (T-04)."""
    return trend_change_pct(_daily(t), [], "day_number", "actual_requests", name="trend_pct")


def tracker_daily_trend(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Daily count with the fitted value; NULL trend for a single day (T-03)."""
    out = trend_line(_daily(t), [], "day_number", "actual_requests", degenerate="null", digits=2, name="trend")
    return out.select("request_date", "actual_requests", "trend")


def _by(t: Tables, col: str) -> DataFrame:
    r = _req(t).where(non_empty(col))
    return r.groupBy(pg_initcap(col).alias(col)).agg(F.count(F.lit(1)).alias("requests"))


def tracker_by_category(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    return _by(t, "category")


def tracker_by_priority(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    return _by(t, "priority")


METRICS = {
    "tracker_opened": tracker_opened,
    "tracker_closed": tracker_closed_count,
    "tracker_avg_days_to_close": tracker_avg_days_to_close,
    "tracker_trend_pct": tracker_trend_pct,
    "tracker_daily_trend": tracker_daily_trend,
    "tracker_by_category": tracker_by_category,
    "tracker_by_priority": tracker_by_priority,
}
