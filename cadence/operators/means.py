"""Means per time bucket from states that merge (A-02, P-03, P-06).

A state is (n, total) of the values in a slot. States of days add up to those of weeks,
months or any wider slot, so a coarser grain never reads the facts again;
``bucket_mean`` takes the states at the wanted grain straight from the facts, with
map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.numeric import round_half_up
from cadence.functions.time import to_day, to_week
from cadence.functions.util import as_col

GRAINS = {
    "day": to_day,
    "week": to_week,
    "month": lambda ts: F.trunc(F.to_date(as_col(ts)), "month"),
    "quarter": lambda ts: F.trunc(F.to_date(as_col(ts)), "quarter"),
    "year": lambda ts: F.trunc(F.to_date(as_col(ts)), "year"),
}


def mean_states(df: DataFrame, keys, ts, value, grain: str = "day", slot: str = "slot") -> DataFrame:
    """Per key and slot: ``n`` rows, ``n_values`` of them with a value, and the ``total`` of the values."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = as_col(value)
    return df.groupBy(*keys, GRAINS[grain](ts).alias(slot)).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"), F.sum(v.cast("double")).alias("total"))


def merge_states(states: DataFrame, keys, slot: str = "slot", grain: str | None = None) -> DataFrame:
    """States of the same key and slot as one; with ``grain`` slots become wider first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = F.col(slot) if grain is None else GRAINS[grain](F.col(slot))
    return states.groupBy(*keys, s.alias(slot)).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"))


def roll_up(states: DataFrame, keys, grains: list[str], slot: str = "slot") -> DataFrame:
    """States of several grains, told apart by the column ``grain``, from one reading of finer ones."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    slots = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), GRAINS[g](F.col(slot)).alias("slot")) for g in grains]))
    wide = states.withColumn("__slots", slots).select(*keys, "__slots.grain", F.col("__slots.slot").alias("__slot"), "n", "n_values", "total")
    return merge_states(wide.withColumnRenamed("__slot", slot), [*keys, "grain"], slot)


def state_mean(unit: float = 1.0, digits: int | None = 2) -> Column:
    """The mean of a state in units of ``unit``; NULL without values."""
    mean = F.try_divide(F.col("total"), F.col("n_values").cast("double")) / F.lit(float(unit))
    return mean if digits is None else round_half_up(mean, digits)


def bucket_mean(df: DataFrame, keys, ts, value, grain: str = "week", unit: float = 1.0, digits: int | None = 2,
                slot: str | None = None, name: str = "mean") -> DataFrame:
    """Mean of ``value`` per key and time bucket; a bucket without any value has NULL."""
    slot = slot or grain
    states = mean_states(df, keys, ts, value, grain, slot)
    return states.withColumn(name, state_mean(unit, digits)).drop("n", "n_values", "total")
