"""Text rules: classes from substrings, PostgreSQL-style INITCAP, version numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.util import as_col


def contains_any(c, needles) -> Column:
    """``c LIKE '%n1%' OR c LIKE '%n2%' …``; NULL text gives NULL (→ false in WHERE)."""
    c = as_col(c)
    return reduce(lambda a, b: a | b, [c.contains(F.lit(n)) for n in needles])


def two_way_class(c, needles, yes: str, no: str) -> Column:
    """``CASE WHEN c LIKE any THEN yes ELSE no END``; NULL text → ``no`` (P-11)."""
    return F.when(contains_any(c, needles), F.lit(yes)).otherwise(F.lit(no))


def prefixed_label(flag: Column, prefix: str, name) -> Column:
    """``CONCAT(CASE WHEN flag THEN prefix ELSE '' END, name)`` with PostgreSQL's
    NULL-skipping CONCAT (P-13)."""
    return F.concat(F.when(flag, F.lit(prefix)).otherwise(F.lit("")), F.coalesce(as_col(name), F.lit("")))


def pg_initcap(c) -> Column:
    """PostgreSQL INITCAP: upper-case the first letter of every run of letters or
    digits, lower-case the rest; every non-alphanumeric character separates (P-14).

    Spark's ``initcap`` only splits on blanks, so split the text into runs of
    letters and digits of any script and other runs, and capitalise the former.
    A letter without a one-letter capital (``ß``) stays.
    """
    runs = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)

    def capital(run: Column) -> Column:
        upper = F.upper(F.substring(run, 1, 1))
        return F.when(run.rlike(r"^[\p{L}\p{N}]") & (F.length(upper) == 1), F.concat(upper, F.substring(run, 2, 1 << 30))).otherwise(run)

    return F.array_join(F.transform(runs, capital), "")


def first_int(c) -> Column:
    """First run of digits as INT, NULL when none (P-15)."""
    return F.nullif(F.regexp_extract(as_col(c), "([0-9]+)", 1), F.lit("")).try_cast("int")


def split_part(c, delim: str, n: int) -> Column:
    """n-th part (1-based); missing part → '' (P-16)."""
    return F.split_part(as_col(c), F.lit(delim), F.lit(n))
