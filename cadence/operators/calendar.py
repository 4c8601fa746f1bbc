"""Calendars, zero-filled counts, open-item counts (C-01 … C-05, J-10, J-11).

Calendars are generated per key with ``explode(sequence(...))`` on the key
table — no cross join — and counts are attached by an equi join on
(key, date). The interval join of open items is rewritten as +1/−1 events and a
running sum, so nothing is a nested-loop join and every window runs over
aggregated (key, day) rows, never over raw facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.time import days_interval, to_day, to_grain, to_week, use_weeks
from cadence.functions.util import as_col
from cadence.operators.period import resolve_as_of


def date_range(start, end, step_days: int = 1) -> Column:
    """Dates from ``start`` to ``end`` inclusive; empty when start > end or a
    bound is NULL (``sequence`` would raise on start > end)."""
    start, end = as_col(start), as_col(end)
    step = F.expr(f"INTERVAL '{int(step_days)}' DAY")
    return F.when(start <= end, F.sequence(start, end, step)).otherwise(F.array().cast("array<date>"))


def calendar(keys: DataFrame, start, end, step_days: int = 1, name: str = "date") -> DataFrame:
    """One row per key and date in [start, end]; ``start``/``end`` may be columns
    of ``keys`` or scalars."""
    key_cols = [c for c in keys.columns if c not in ("__start", "__end")]
    return keys.select(*key_cols, F.explode(date_range(start, end, step_days)).alias(name))


def period_calendar(keys: DataFrame, days: int, as_of=None, switch: int = 240, name: str = "date") -> DataFrame:
    """Day calendar from (as_of − days) to as_of, or Monday weeks from
    ``switch`` days on — both ends truncated to Mondays (C-01)."""
    now = resolve_as_of(as_of)
    lo = to_day(now - days_interval(days))
    hi = to_day(now)
    if use_weeks(days, switch):
        return calendar(keys, to_week(lo), to_week(hi), 7, name)
    return calendar(keys, lo, hi, 1, name)


def stepped_week_calendar(keys: DataFrame, days: int, as_of=None, switch: int = 240,
                          name: str = "date", complete: bool = False) -> DataFrame:
    """C-03: step from (as_of − days) by 1 day or 7 days, then truncate each step
    to its Monday. The current week is missing when the start weekday is later
    than today's; ``complete=True`` uses :func:`period_calendar` instead."""
    if complete or not use_weeks(days, switch):
        return period_calendar(keys, days, as_of, switch, name)
    now = resolve_as_of(as_of)
    lo = to_day(now - days_interval(days))
    hi = to_day(now)
    steps = calendar(keys, lo, hi, 7, "__d")
    key_cols = [c for c in keys.columns]
    return steps.select(*key_cols, to_week("__d").alias(name)).distinct()


def zero_filled_counts(df: DataFrame, keys: DataFrame, key: str, ts: str, days: int, as_of=None,
                       switch: int = 240, count_name: str = "pr_count", name: str = "date") -> DataFrame:
    """Counts per key and calendar slot with 0 for empty slots (C-01, C-04, J-10).

    ``df`` must already be filtered to the period; ``keys`` lists every key that
    gets a calendar (with zero rows for keys without facts).
    """
    counts = df.groupBy(F.col(key), to_grain(ts, days, switch).alias(name)).agg(F.count(F.lit(1)).alias(count_name))
    cal = period_calendar(keys.select(key), days, as_of, switch, name)
    return cal.join(counts, [key, name], "left").select(
        key, name, F.coalesce(F.col(count_name), F.lit(0)).cast("bigint").alias(count_name)
    )


def open_per_day(df: DataFrame, key: str, start: str, end: str, as_of=None, name: str = "date",
                 count_name: str = "open_prs") -> DataFrame:
    """Items open on each day from the first start day to ``as_of``'s day (C-05).

    An item is open on day d when ``start_day <= d < end_day``; a missing end
    means open through the as-of day (end = as_of day + 1). Instead of joining
    every day to every item (a nested-loop join) each item emits +1 on its start
    day and −1 on its end day; deltas are summed per (key, day), and the running
    sum holds for every day up to the next delta. The items are read once, and
    days without events come from the span before them. Items closing on or
    before their start day never count, as in the interval form.
    """
    now = resolve_as_of(as_of)
    today = to_day(now)
    s = to_day(start)
    e = F.coalesce(to_day(end), F.date_add(today, 1))
    items = df.select(F.col(key), s.alias("__s"), e.alias("__e")).where(F.col("__s") <= today)
    lasts = F.coalesce(F.col("__e") > F.col("__s"), F.lit(False))
    deltas = (
        items.select(key, F.explode(F.array_compact(F.array(
            # an item without a day counts 0, so that the first day of its key is known
            F.struct(F.col("__s").alias("d"), F.when(lasts, 1).otherwise(0).alias("v")),
            F.when(lasts, F.struct(F.col("__e").alias("d"), F.lit(-1).alias("v"))),
        ))).alias("ev"))
        .groupBy(key, F.col("ev.d").alias("__from"))
        .agg(F.sum("ev.v").alias("__delta"))
    )
    w = Window.partitionBy(key).orderBy("__from")
    spans = deltas.select(
        key, "__from", F.sum("__delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias(count_name),
        F.least(F.coalesce(F.date_sub(F.lead("__from").over(w), 1), today), today).alias("__to"))
    return spans.where(F.col("__from") <= F.col("__to")).select(
        key, F.explode(F.sequence("__from", "__to")).alias(name), count_name)


def running_total(df: DataFrame, keys, date: str, value: str, class_col: str | None = None,
                  name: str = "cumulative_count") -> DataFrame:
    """Running sum of ``value`` by ``date`` within each key (and class) (W-04, W-05).

    Meant for rows already aggregated per (key, date[, class]); the window then
    holds at most one row per day per key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = keys + ([class_col] if class_col else [])
    w = Window.partitionBy(*part).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def daily_running_total(df: DataFrame, keys, ts: str, class_col=None, date_name: str = "run_date",
                        name: str = "cumulative_count") -> DataFrame:
    """Count per (key, day[, class]) then the running total per key[, class] (A-16)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    group = keys + [to_day(ts).alias(date_name)]
    if class_col is not None:
        group.append(class_col)
    daily = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    cls = class_col if isinstance(class_col, str) or class_col is None else daily.columns[len(keys) + 1]
    out = running_total(daily, keys, date_name, "__n", cls, name)
    return out.drop("__n")
