"""Numeric expressions: exact-decimal rounding, null-safe division, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.util import as_col


def round_half_up(x, digits: int = 2) -> Column:
    """Round half away from zero on an exact numeric, returned as DOUBLE (P-06).

    Going through DECIMAL(28,8) first removes binary noise (1.005 stored as
    1.00499… rounds to 1.01, as exact arithmetic would), so both engines agree.
    """
    return F.round(as_col(x).cast("decimal(28,8)"), digits).cast("double")


def safe_div(a, b) -> Column:
    """``a / NULLIF(b, 0)`` that never raises under ANSI mode (P-07)."""
    return F.try_divide(as_col(a).cast("double"), F.nullif(as_col(b).cast("double"), F.lit(0.0)))


def clamp_min(x, floor=0) -> Column:
    """``GREATEST(x, floor)``; NULL stays NULL like the SQL form (P-10)."""
    x = as_col(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(x, F.lit(floor)))


def zero_to_null(x) -> Column:
    """Card rule: 0 or missing → NULL (P-24)."""
    return F.nullif(as_col(x), F.lit(0))
