"""Membership of names in a table of members (J-07, J-08, P-20, O-06).

The members come from a table of any size, not from a list in the plan: Spark
broadcasts the distinct names when their measured size allows it and shuffles
both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_names(members: DataFrame, col: str = "username") -> DataFrame:
    """Distinct names, NULL left out, as ``__member``."""
    return members.select(F.col(col).alias("__member")).where("__member is not null").distinct()


def with_membership(df: DataFrame, members: DataFrame, cols: list[str], col: str = "username", prefix: str = "is_member_") -> DataFrame:
    """``df`` with a flag per column: true for a member, false for another name, NULL for NULL (as ``IN`` gives)."""
    names = member_names(members, col)
    out = df
    for c in cols:
        hit = names.withColumnsRenamed({"__member": f"__m_{c}"})
        out = out.join(hit, F.col(c) == F.col(f"__m_{c}"), "left")
        out = out.withColumn(prefix + c, F.when(F.col(c).isNotNull(), F.col(f"__m_{c}").isNotNull())).drop(f"__m_{c}")
    return out


def member_rows(df: DataFrame, members: DataFrame, cols: list[str], col: str = "username", name: str = "member") -> DataFrame:
    """A row per row of ``df`` and member named in ``cols``; a name in a later column counts only if it differs from
    those in the earlier ones, and not beside a NULL there (as ``!=`` gives).

    All columns meet the members in one join.
    """
    named = []
    for i, c in enumerate(cols):
        differs = F.lit(True)
        for earlier in cols[:i]:
            differs = differs & (F.col(c) != F.col(earlier))
        named.append(F.when(differs, F.col(c)))
    stacked = df.withColumn(name, F.explode(F.array(*named))).where(F.col(name).isNotNull())
    return stacked.join(member_names(members, col), F.col(name) == F.col("__member"), "left_semi")


def membership_counts(df: DataFrame, members: DataFrame, cols: list[str], keys, aggs: list[Column], col: str = "username",
                      name: str = "member") -> DataFrame:
    """``aggs`` per key and member over the rows that name the member in one of ``cols``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return member_rows(df, members, cols, col, name).groupBy(*keys, name).agg(*aggs)


def membership_split(df: DataFrame, members: DataFrame, c: str, keys: list, col: str = "username",
                     inside: str = "inside", outside: str = "outside") -> DataFrame:
    """Rows per key whose ``c`` is a member, and whose ``c`` is another name; NULL counts in neither (J-08)."""
    flagged = with_membership(df, members, [c], col)
    flag = F.col(f"is_member_{c}")
    return flagged.groupBy(*keys).agg(F.count_if(flag).alias(inside), F.count_if(~flag).alias(outside))
