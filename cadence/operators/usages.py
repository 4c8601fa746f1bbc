"""Shared-workflow usages found in file texts (I-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the usage pattern around the escaped prefix ---
USES_LEAD = r"uses:\s*"
NAME_CHARS = r"""[^@\s"'\n]+"""
REF_CHARS = r"""[^\s"'\n]+"""
# --- end of fixed values ---


def escape_regex(text: str) -> str:
    """The text as a literal of Java's patterns: quoted, and a closing quote in it quoted apart."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def usage_pattern(prefix: str, lead: str = USES_LEAD) -> str:
    """``lead (prefix name) (@ref)?`` — group 1 the workflow, group 3 the ref."""
    return f"{lead}({escape_regex(prefix)}({NAME_CHARS}))(?:@({REF_CHARS}))?"


def extract_usages(files: DataFrame, text_col: str, prefix: str, lead: str = USES_LEAD,
                   repository: str = "repository", caller_file: str = "caller_file") -> DataFrame:
    """Every match in every file → (repository, caller_file, dx_workflow, ref).

    The first match of a workflow in a file gives the ref. That is a fold inside the
    row: the distinct workflows of a file, each with the ref at its first place, so
    matches of a file that comes once are never shuffled. Only files that come
    several times (found by a count over their names) meet; there the least place
    counts, then the least ref. Files without repository or path are skipped.
    """
    pat = usage_pattern(prefix, lead)
    f = files.where(
        F.col(repository).isNotNull() & (F.col(repository) != "")
        & F.col(caller_file).isNotNull() & (F.col(caller_file) != "")
    ).select(F.col(repository).alias("repository"), F.col(caller_file).alias("caller_file"), F.col(text_col).alias("__text"))
    file = ["repository", "caller_file"]
    again = f.groupBy(*file).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*file)
    once = _first_matches(f.join(again, file, "left_anti"), pat).drop("pos")
    several = _first_matches(f.join(again, file, "left_semi"), pat)
    w = Window.partitionBy(*file, "dx_workflow").orderBy("pos", "ref")
    met = several.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    return once.unionByName(met.select(*once.columns))


def _first_matches(files: DataFrame, pat: str) -> DataFrame:
    """(repository, caller_file, dx_workflow, ref, pos): the first match of each workflow in each row."""
    found = files.select("repository", "caller_file", F.regexp_extract_all("__text", F.lit(pat), 1).alias("w"),
                         F.regexp_extract_all("__text", F.lit(pat), 3).alias("r"))
    firsts = F.transform(F.array_distinct("w"), lambda x: F.struct(
        x.alias("dx_workflow"), F.nullif(F.element_at("r", F.array_position("w", x).cast("int")), F.lit("")).alias("ref"),
        F.array_position("w", x).alias("pos")))
    return found.select("repository", "caller_file", F.inline(firsts))
