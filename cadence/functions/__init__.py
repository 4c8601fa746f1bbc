"""Column expressions (pure, lazy, JVM-side)."""

from cadence.functions.numeric import clamp_min, round_half_up, safe_div, zero_to_null
from cadence.functions.predicates import (
    non_empty,
    not_draft,
    not_in,
    not_relative_path,
    since,
    tracker_closed,
    trimmed_eq,
    trimmed_in,
    within,
)
from cadence.functions.text import contains_any, first_int, pg_initcap, prefixed_label, split_part, two_way_class
from cadence.functions.time import (
    days_interval,
    elapsed,
    elapsed_seconds,
    lit_ntz,
    to_date_text,
    to_day,
    to_grain,
    to_month_text,
    to_week,
    use_weeks,
)

__all__ = [name for name in dir() if not name.startswith("_")]
