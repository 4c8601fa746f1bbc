"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Four ratios of a text (mean word length, symbols per word, repeated lines per
line, words in repeated windows per word) are compared with fences of their
own population, language and source, in place of fixed cutoffs:

    word length: median - REACH * spread ... median + REACH * spread
    the others:  upper quantile + REACH * (upper quantile - upper quartile), at most

with spread = the smaller of median - lower quartile and upper quartile -
median (at least SLACK), so that junk on one side cannot widen the fence. The
others are zero in most texts, so their median and quartiles say nothing; the
quantile UPPER does, and stands as long as junk is a smaller part than 1 -
UPPER. Their fence leaves room for FLOOR counts in the text at hand (at most
SLACK). For texts with fewer words than the median text the spreads grow with
the square root of the ratio, as the error of a mean does.

The quartiles come from sketches of log-sized buckets (relative error
ACCURACY): a sketch is a table of bucket counts, so it merges by adding counts,
in any order, with map-side combine, and a group that holds a third of all
rows is no larger than any other. Sketches of languages and of all documents
are sums of the sketches of (language, source). A population with under
MIN_GROUP texts takes the fences of its language, and that of all documents if
that is small too. The population is every text that passes the base rules.

Null and edge cases: a null or wordless text has zero counts and fails the base
rules; null language or source is a population of its own; repeated rows are
judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage
from cadence.llm.text_stats import base_counts

ACCURACY = 0.01
#: Fences lie so many spreads from the median.
REACH = 8.0
MIN_GROUP = 200
#: Least distance of the word-length fences from the median; for the other ratios the most that FLOOR may allow.
SLACK = {"word_length": 0.5, "symbol_ratio": 0.1, "dup_line_ratio": 0.35, "repeat_ratio": 0.15}
QUARTILES = (0.25, 0.5, 0.75)
UPPER = 0.9
#: Counts that any text may have, and what they are counted against: one symbol, one repeated line, one phrase of ten words twice.
FLOOR = {"symbol_ratio": (1, "n_words"), "dup_line_ratio": (1, "n_lines"), "repeat_ratio": (20, "n_words")}

_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_ZERO = -(1 << 30)
_METRICS = [*SLACK, "n_words"]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = pd.DataFrame([(*base_counts(t), 1 + t.count("\n") if t else 0) for t in batch["text"]],
                              columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])
        yield pd.concat([batch.drop(columns="text").reset_index(drop=True), counts], axis=1)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """Counts, ratios and the base verdict of every row."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                    F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    counted = src.mapInPandas(_count, f"doc_id {id_type}, lang string, source string, n_words long, word_chars long, "
                                      "n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns({
        "word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "base_failed": (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")),
    })


def bucket_of(value: Column) -> Column:
    """Sketch bucket of a value that is not negative: bucket b holds (gamma^(b-1), gamma^b]."""
    return F.when(value > 0, F.ceil(F.log(value.cast("double")) / F.lit(log(_GAMMA))).cast("int")).otherwise(F.lit(_ZERO))


def value_of(bucket: Column) -> Column:
    """The value that stands for a bucket, within ACCURACY of all values in it."""
    return F.when(bucket == F.lit(_ZERO), F.lit(0.0)).otherwise(
        F.lit(2 / (1 + _GAMMA)) * F.pow(F.lit(_GAMMA), bucket.cast("double")))


def sketch(rows: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """groups + metric, bucket, n: one mergeable sketch per group and metric."""
    each = rows.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), bucket_of(F.col(m)).alias("bucket")) for m in metrics])).alias("m"))
    return each.groupBy(*groups, "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups: the counts added up."""
    return sketches.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], at: tuple[float, ...] = QUARTILES) -> DataFrame:
    """groups + metric, n, q_0, q_1, ...: the values at the ranks ceil(q * n). A window sees the buckets of one sketch."""
    by = Window.partitionBy(*groups, "metric")
    ranked = sketches.select(*groups, "metric", "bucket", F.sum("n").over(by).alias("total"),
                             F.sum("n").over(by.orderBy("bucket")).alias("upto"))
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q))), F.col("bucket")))
             for q in at]
    return ranked.groupBy(*groups, "metric").agg(
        F.first("total").alias("n"), *[value_of(p).alias(f"q_{i}") for i, p in enumerate(picks)])


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and a struct {n, q_0, q_1, q_2, q_3} per ratio, from the smallest population that is large enough."""
    passed = measured.where(~F.col("base_failed"))
    fine = stage(sketch(passed, ["lang", "source"], _METRICS), "sketches")
    at = (*QUARTILES, UPPER)
    stats = F.struct("n", *[f"q_{i}" for i in range(len(at))])

    def table(sk: DataFrame, groups: list[str], prefix: str) -> DataFrame:
        per = quantiles(sk, groups, at)
        return per.groupBy(*groups).agg(*[F.max(F.when(F.col("metric") == m, stats)).alias(prefix + m) for m in _METRICS])

    by_source = table(fine, ["lang", "source"], "s_")
    by_lang = table(merge(fine, ["lang"]), ["lang"], "l_").withColumnRenamed("lang", "l_lang")
    overall = {r.metric: r for r in quantiles(merge(fine, []), [], at).collect()}  # one row a ratio
    joined = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")

    def pick(m: str) -> Column:
        out = F.when(F.col(f"s_{m}.n") >= MIN_GROUP, F.col(f"s_{m}")).when(F.col(f"l_{m}.n") >= MIN_GROUP, F.col(f"l_{m}"))
        if m in overall:
            r = overall[m]
            out = out.otherwise(F.struct(F.lit(r.n).alias("n"), *[F.lit(r[f"q_{i}"]).alias(f"q_{i}") for i in range(len(at))]))
        return out.alias(f"t_{m}")

    return joined.select("lang", "source", *[pick(m) for m in _METRICS])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows with the fences of their population and the verdict."""
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    rows = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    wide = F.sqrt(F.greatest(F.lit(1.0), F.col("t_n_words.q_1") / F.greatest(F.col("n_words"), F.lit(1))))
    fences, inside = {}, ~F.col("base_failed")
    for m, slack in SLACK.items():
        t = F.col(f"t_{m}")
        if m == "word_length":
            spread = F.least(t["q_1"] - t["q_0"], t["q_2"] - t["q_1"])
            reach = F.greatest(F.lit(slack), F.lit(REACH) * spread) * wide
            fences[f"{m}_max"] = t["q_1"] + reach
        else:
            counts, length = FLOOR[m]
            least = F.least(F.lit(slack), F.lit(counts) / F.greatest(F.col(length), F.lit(1)))
            fences[f"{m}_max"] = F.when(t.isNotNull(), F.greatest(least, t["q_3"] + F.lit(REACH) * (t["q_3"] - t["q_2"]) * wide))
        inside = inside & F.coalesce(F.col(m) <= fences[f"{m}_max"], F.lit(True))
        if m == "word_length":
            fences[f"{m}_min"] = t["q_1"] - reach
            inside = inside & F.coalesce(F.col(m) >= fences[f"{m}_min"], F.lit(True))
    return rows.withColumns({**fences, "kept": inside}).drop("t_lang", "t_source", *[f"t_{m}" for m in _METRICS])


def apply_rules(df: DataFrame, **columns: str) -> DataFrame:
    """Every row with its counts, ratios, fences, ``base_failed`` and ``kept``."""
    measured = stage(measure(df, **columns), "measured")
    return judge(measured, stage(thresholds(measured), "thresholds"))


def op1_adaptive_quality_rules(spark, sf_dir):
    """All ``documents`` with the verdict of the rules."""
    out = apply_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "word_length", "word_length_min", "word_length_max", "symbol_ratio", "symbol_ratio_max",
                      "dup_line_ratio", "dup_line_ratio_max", "repeat_ratio", "repeat_ratio_max")
