"""Least-squares trend lines (T-01 … T-04).

All statistics are per key aggregates (``regr_slope``, ``avg``, ``count``),
joined back to the points on the key: no cross join, no global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.numeric import clamp_min, round_half_up
from cadence.operators.ordinal import join_null_safe, ranked_cells


def trend_stats(points: DataFrame, keys, x: str, y: str, degenerate: str = "zero") -> DataFrame:
    """Per key: slope and intercept of y on x.

    ``degenerate='zero'``: slope 0 when x has no spread (one point), intercept
    = mean y (T-01/T-02). ``'null'``: slope and intercept stay NULL (T-03/T-04).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    stats = points.groupBy(*keys).agg(
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("__slope"),
        F.avg(F.col(x).cast("double")).alias("__xbar"),
        F.avg(F.col(y).cast("double")).alias("__ybar"),
        F.count(F.lit(1)).alias("__n"),
    )
    if degenerate == "zero":
        slope = F.coalesce(F.col("__slope"), F.lit(0.0))
    elif degenerate == "null":
        slope = F.col("__slope")
    else:
        raise ValueError(degenerate)
    return stats.select(
        *keys,
        slope.alias("slope"),
        (F.col("__ybar") - slope * F.col("__xbar")).alias("intercept"),
        F.col("__n").alias("n"),
    )


def trend_line(points: DataFrame, keys, x: str, y: str, degenerate: str = "zero", digits: int = 2,
               floor=None, name: str = "trend_line") -> DataFrame:
    """Fitted value for every point, rounded; optionally clamped at ``floor``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    fitted = round_half_up(F.col("slope") * F.col(x).cast("double") + F.col("intercept"), digits)
    if floor is not None:
        fitted = clamp_min(fitted, float(floor))
    if not keys:  # one series: its line is one row, a scalar beside the points
        line = trend_stats(points, [], x, y, degenerate).select(F.struct("slope", "intercept").alias("line")).scalar()
        fit = points.withColumn("__line", line)
        value = round_half_up(F.col("__line.slope") * F.col(x).cast("double") + F.col("__line.intercept"), digits)
        return fit.withColumn(name, clamp_min(value, float(floor)) if floor is not None else value).drop("__line")
    stats = trend_stats(points, keys, x, y, degenerate).drop("n")
    return points.join(stats, keys, "inner").withColumn(name, fitted).drop("slope", "intercept")


def ordinal_trend_line(df: DataFrame, keys, day: str, number: str, y: str, digits: int = 2, floor=None,
                       name: str = "trend_line") -> DataFrame:
    """Fitted value of every row over its ordinal in its key, by ``day``, then ``number`` (T-02); slope 0 for one row.

    The ordinal comes from counting cells (:func:`ranked_cells`), which add up
    the moments of the line as well: the rows are shuffled once and meet one row
    of their cell. The sums of x need no rows, as x runs from 1 to n. ``y`` must
    not be NULL.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows, cells = ranked_cells(df, keys, day, number, F.col(y).cast("double"))
    n, sum_y = F.col("__n"), F.col("__y")
    xbar, spread = (n + 1.0) / 2.0, n * (n * n - 1.0) / 12.0
    slope = F.coalesce(F.try_divide(F.col("__xy") - xbar * sum_y, spread), F.lit(0.0))
    lines = cells.select(*keys, day, "__cell", "__before", slope.alias("__slope"), (sum_y / n - slope * xbar).alias("__at0"))
    out = join_null_safe(rows, lines, [*keys, day, "__cell"])
    fitted = round_half_up(F.col("__slope") * (F.col("__before") + F.col("__rank")).cast("double") + F.col("__at0"), digits)
    return out.withColumn(name, clamp_min(fitted, float(floor)) if floor is not None else fitted).select(*df.columns, name)


def trend_change_pct(points: DataFrame, keys, x: str, y: str, digits: int = 2,
                     name: str = "trend_pct") -> DataFrame:
    """Percent change between the fitted first (x=1) and last (x=n) point; NULL
    when the first fitted value is 0 or x has no spread (T-04)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = trend_stats(points, keys, x, y, "null")
    first = F.col("slope") * F.lit(1.0) + F.col("intercept")
    last = F.col("slope") * F.col("n").cast("double") + F.col("intercept")
    pct = F.try_divide(last - first, F.nullif(first, F.lit(0.0))) * F.lit(100.0)
    return s.select(*keys, round_half_up(pct, digits).alias(name))
