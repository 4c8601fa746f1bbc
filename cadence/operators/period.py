"""Trailing periods and data anchors (F-01 … F-04, A-12)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.predicates import since, within
from cadence.functions.time import lit_ntz
from cadence.functions.util import as_col


def resolve_as_of(as_of=None) -> Column:
    """The "now" of a metric as a TIMESTAMP_NTZ column.

    Pass a datetime / ISO text for repeatable results, or a Column (for example
    a scalar subquery over the data). ``None`` means the wall clock, like the
    original dashboards.
    """
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (str, _dt.date)):
        return lit_ntz(as_of)
    raise TypeError(f"unsupported as_of: {as_of!r}")


def trailing_period(df: DataFrame, ts: str, days: int, as_of=None, anchor: str | None = None,
                    upper: bool = False) -> DataFrame:
    """Rows whose ``ts`` lies in the ``days`` before the anchor.

    The anchor is ``as_of`` (a scalar) or, when ``anchor`` names a column, a
    per-row value such as the latest data time of the row's repository (joined
    in by :func:`with_anchor`). ``upper`` adds ``ts <= anchor``.
    """
    a = F.col(anchor) if anchor else resolve_as_of(as_of)
    cond = within(ts, a, days) if upper else since(ts, a, days)
    return df.where(cond)


def latest_anchor(df: DataFrame, keys, ts_cols, default=None, name: str = "anchor") -> DataFrame:
    """Per key: latest of the given timestamps, else ``default`` (A-12).

    ``GREATEST`` skips NULLs, so a row with only one of the two stamps counts.
    A partial aggregate: one row per key leaves each task, whatever the skew.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [as_col(c) for c in ([ts_cols] if isinstance(ts_cols, str) else ts_cols)]
    latest = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return df.groupBy(*keys).agg(F.coalesce(F.max(latest), resolve_as_of(default)).alias(name))


def with_anchor(df: DataFrame, anchors: DataFrame, keys, name: str = "anchor") -> DataFrame:
    """Attach the per-key anchor; the anchor table has one row per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(anchors.select(*keys, name), keys, "inner")
