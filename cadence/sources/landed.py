"""Readers of landed payloads (S-02 … S-07) — the files an external fetcher
writes; no HTTP here. Everything stays a DataFrame: JSON through the JSON
reader or VARIANT, CSV lines through JVM-side regex splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.util import as_col

# --- fixed values: tracker export headers (found by substring, any case) ---
TRACKER_HEADERS = {
    "submitted": "data di invio",
    "closed": "data di scadenza",
    "category": "tipologia",
    "priority": "priorit",
    "is_closed": "completato",
    "status": "status",
}
# a field: plain characters or quoted runs (a quote toggles; an open quote runs to the end)
CSV_FIELD = r'(?:^|,)((?:[^,"]|"[^"]*(?:"|$))*)'
SHORT_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{2}),?\s*(\d{1,2}):(\d{1,2})$"
ZONE = r"(?<=:\d\d(?:\.\d{1,9})?)\s?(Z|[+-]\d{2}:?\d{2})$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
# --- end of fixed values ---


def read_json_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed API pages (S-02): one JSON document (object or array of items) per
    file, read with an explicit schema — no inference over 100 TB."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decode_base64(c) -> Column:
    """Base64 file content → text, NULL when it is malformed (S-03)."""
    return F.try_to_binary(as_col(c), F.lit("base64")).cast("string")


def _text_or_empty(item: Column, field: str) -> Column:
    v = F.try_variant_get(item, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(item, f"$.{field}", "string")).otherwise(F.lit(""))


def parse_module_scan(df: DataFrame, text_col: str, repository_col: str) -> DataFrame:
    """Module-scan JSON (S-04): ``modules`` items that are objects; a field of
    the wrong type becomes '' (text) or 0 (line number)."""
    doc = F.try_parse_json(F.col(text_col))
    items = df.select(F.col(repository_col).alias("repository"),
                      F.explode(F.try_variant_get(doc, "$.modules", "array<variant>")).alias("it"))
    items = items.where(F.schema_of_variant("it").startswith("OBJECT"))
    ln = F.try_variant_get("it", "$.lineNumber", "variant")
    return items.select(
        "repository",
        *[_text_or_empty(F.col("it"), f).alias(f) for f in ("source", "sourceType", "version", "filePath")],
        _text_or_empty(F.col("it"), "repository").alias("scan_repository"),
        F.when(F.schema_of_variant(ln).isin("BIGINT", "DOUBLE", "DECIMAL") | F.schema_of_variant(ln).startswith("DECIMAL"),
               F.variant_get("it", "$.lineNumber", "double")).otherwise(F.lit(0.0)).alias("lineNumber"),
    )


def parse_registry_modules(df: DataFrame, text_col: str) -> DataFrame:
    """Registry module pages (S-05): items with text name, provider and
    namespace; anything else is dropped."""
    doc = F.try_parse_json(F.col(text_col))
    items = df.select(F.explode(F.try_variant_get(doc, "$.modules", "array<variant>")).alias("it"))
    fields = ("name", "provider", "namespace")
    cond = F.lit(True)
    for f in fields:
        cond = cond & (F.schema_of_variant(F.try_variant_get("it", f"$.{f}", "variant")) == "STRING")
    return items.where(cond).select(*[F.variant_get("it", f"$.{f}", "string").alias(f) for f in fields])


def parse_registry_versions(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Versions of the first module of a versions page; non-text items dropped (S-05)."""
    doc = F.try_parse_json(F.col(text_col))
    first = F.try_variant_get(doc, "$.modules[0].versions", "array<variant>")
    v = df.select(*keys, F.explode(first).alias("it"))
    ver = F.try_variant_get("it", "$.version", "variant")
    return v.where(F.schema_of_variant(ver) == "STRING").select(*keys, F.variant_get("it", "$.version", "string").alias("version"))


def parse_published_at(c) -> Column:
    """``published_at`` text → timestamp, NULL when missing or unparsable (S-05)."""
    doc = F.try_parse_json(as_col(c))
    return iso_utc(F.try_variant_get(doc, "$.published_at", "string"))


def iso_utc(c) -> Column:
    """ISO date or date-time text → UTC wall time, NULL when unparsable. An
    offset is applied by arithmetic on the text, so the session's zone plays no
    part; text without an offset is UTC."""
    r = as_col(c)
    zone = F.regexp_extract(r, ZONE, 1)
    local = F.regexp_replace(r, ZONE, "").try_cast("timestamp_ntz")
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(minutes, F.lit(0)))


def tracker_date(raw, strict: bool = False) -> Column:
    """Tracker dates (P-17): day-first ``d/m/yy[,] h:m`` in century 2000, with
    JavaScript-style overflow (31/2 → early March) unless ``strict``; else an
    ISO date(-time); else NULL."""
    r = as_col(raw)
    g = [F.regexp_extract(r, SHORT_DATE, i).try_cast("int") for i in range(1, 6)]
    matched = r.rlike(SHORT_DATE)
    if strict:
        short = F.try_make_timestamp_ntz(g[2] + 2000, g[1], g[0], g[3], g[4], F.lit(0))
    else:
        base = F.date_add(F.add_months(F.make_date(g[2] + 2000, F.lit(1), F.lit(1)), g[1] - 1), g[0] - 1)
        short = base.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), g[3], g[4])
    iso = iso_utc(r)
    return F.when(r.isNull() | (r == ""), F.lit(None).cast("timestamp_ntz")).when(matched, short).when(
        r.rlike(ISO_DATE), iso
    )


def split_csv_line(line) -> Column:
    """Fields of one CSV line by the export's rule: a quote toggles quoting and
    is dropped, commas outside quotes split, fields are trimmed (S-06)."""
    raw = F.regexp_extract_all(as_col(line), F.lit(CSV_FIELD), 1)
    return F.transform(raw, lambda f: F.trim(F.regexp_replace(f, '"', "")))


def read_tracker_csv(spark: SparkSession, path: str, strict_dates: bool = False) -> DataFrame:
    """Tracker export → tracker_requests rows (S-06, S-07, I-12).

    Lines split on newline, blank lines dropped; the first line of every file is
    its header, in which the columns are found by substring (case-insensitive).
    A missing column, an empty value or the text 'undefined' gives ''. A file
    with fewer than two lines gives no rows (the caller keeps the stored table,
    as the original does). Headers are found by one aggregate with a row per
    file, joined to the lines: no global sort, nothing on the driver.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    return parse_tracker_lines(lines, strict_dates)


def parse_tracker_lines(lines: DataFrame, strict_dates: bool = False) -> DataFrame:
    """The rows of tracker exports given as lines: ``file``, ``at`` (any type that sorts lines of a file, unique in it), ``value``."""
    lines = lines.where(F.trim("value") != "").select("value", F.col("file").alias("__file"), F.col("at").alias("__at"))
    heads = lines.groupBy("__file").agg(F.min_by("value", "__at").alias("head"), F.min("__at").alias("__first"))
    names = F.transform(split_csv_line("head"), F.lower)

    def place(sub: str) -> Column:
        return F.array_position(F.transform(names, lambda n: n.contains(sub)), F.lit(True)).cast("int")

    heads = heads.select("__file", "__first", *[place(sub).alias(f"__i_{k}") for k, sub in TRACKER_HEADERS.items()])
    body = lines.join(heads, "__file").where(F.col("__at") != F.col("__first")).withColumn("f", split_csv_line("value"))

    def value(k: str) -> Column:
        v = F.when(F.col(f"__i_{k}") > 0, F.get(F.col("f"), F.col(f"__i_{k}") - 1))
        return F.when(v.isNull() | (v == "") | (v == "undefined"), F.lit("")).otherwise(v)

    return body.select(
        tracker_date(value("submitted"), strict_dates).alias("submitted_at"),
        tracker_date(value("closed"), strict_dates).alias("closed_at"),
        value("category").alias("category"),
        value("priority").alias("priority"),
        value("is_closed").alias("is_closed"),
        value("status").alias("status"),
        value("submitted").alias("raw_submitted_at"),
        value("closed").alias("raw_closed_at"),
    )
