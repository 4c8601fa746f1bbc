"""Quality classifier with hierarchical empirical Bayes.

1. Evidence of the document: a logistic regression over ratios of the text
   (``FEATURES``), fitted on at most FIT_ROWS labelled rows, chosen by a hash of
   their id. It gives the log odds l of good against the prior.
2. Posterior of the site: over all documents, the expected number of good ones
   is summed per host and per path (grouped aggregation of p = sigmoid(l)). The
   mean of a host is shrunk toward the global mean, that of a path toward its
   host: (sum + k * parent) / (n + k), so a sparse site stays at its parent. The
   strength k of a level is estimated by the method of moments from the spread
   between sites (``_strength``). A document does not vote on itself: its own p
   is taken out of the sums that judge it.
3. Verdict: logit(p) + SITE_WEIGHT * (logit(path posterior) - logit(global mean)),
   kept when that is at least ``cut``, 0 by default (even odds).

Host and path come from columns; ``documents`` has no address, so its source is
the host and (source, language) the path. ``site_of_url`` derives both from an
address.

Null and edge cases: a null or empty text has all-zero ratios and is judged by
them; null host or path is a site of its own; labels of unknown ids or null
labels are ignored, a repeated label row counts once per row; without labels of
both kinds the evidence is 0 for all and everything is kept; repeated rows are
judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage
from cadence.llm.text_stats import base_counts

#: Labelled rows used for the fit at most.
FIT_ROWS = 20_000
#: Weight of a site's log odds against the document's own.
SITE_WEIGHT = 0.5
#: Bounds of the shrinkage strength, in documents.
STRENGTH = (2.0, 1000.0)
FEATURES = ("log_words", "word_length", "word_length_off", "symbols", "dup_lines", "repeats", "upper", "marks", "distinct",
            "top_word", "digits", "non_letters")

_LETTERS = re.compile(r"[^\W\d_]")
_UPPER_WORD = re.compile(r"\b[^\W\d_a-z]{2,}\b")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    n, chars, symbols, dup, repeat = base_counts(text)
    words = Counter(text.split())
    total = max(1, sum(words.values()))
    lines = 1 + text.count("\n")
    w = max(n, 1)
    upper = sum(c for x, c in words.items() if len(x) > 1 and x.isupper())
    letters = sum(len(_LETTERS.findall(x)) * c for x, c in words.items())
    digits = sum(sum(map(str.isdigit, x)) * c for x, c in words.items())
    length = chars / w
    return [float(np.log1p(n)), length, max(0.0, length - 6.0), min(symbols / w, 2.0), dup / lines, repeat / w, upper / total,
            min(text.count("!") / w, 2.0), len(words) / total if total >= 50 else 0.8,
            max(words.values(), default=0) / total if total >= 20 else 0.05, digits / max(chars, 1),
            1 - letters / max(chars, 1)]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = np.array([features(t) for t in batch["text"]], dtype=float).reshape(len(batch), len(FEATURES))
        yield pd.concat([batch.drop(columns="text").reset_index(drop=True), pd.DataFrame(values, columns=list(FEATURES))], axis=1)


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host, F.concat_ws("/", host, F.split_part(F.try_parse_url(url, F.lit("PATH")), F.lit("/"), F.lit(2)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression by Newton's method; (0, 0) if a class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (p - y) + penalty * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    w = b[:-1] / scale
    return w, float(b[-1] - w @ mean)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (F.lit(1.0) - p))


def _strength(sites: DataFrame, parent: Column, n: str, total: str, within: str) -> float:
    """Method of moments: how many documents of its parent's mean a site's own are worth.

    The observed spread of site means around the parent is the true spread plus
    within / n; ``within`` is a column with the variance of p inside the site.
    """
    mean = F.col(total) / F.col(n)
    r = sites.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * F.pow(mean - parent, 2)).alias("between"), F.sum(F.col(within)).alias("inside"),
        F.sum(n).alias("docs"), F.count(F.lit(1)).alias("sites")).first()
    if not r.sites or not r.docs:
        return STRENGTH[1]
    inside = r.inside / r.sites
    spread = max(0.0, (r.between - r.sites * inside) / r.docs)
    return float(min(STRENGTH[1], max(STRENGTH[0], inside / spread if spread > 0 else STRENGTH[1])))


def _sample(labelled: DataFrame) -> DataFrame:
    """The FIT_ROWS rows with the least hashes. Only rows below a bound that a few more than FIT_ROWS should reach take
    part, so that not every task hands its own FIT_ROWS to the driver; if too few do, as ids repeat, all rows take part."""
    rows = labelled.count()
    if rows > 2 * FIT_ROWS:
        bound = (1 << 64) * FIT_ROWS * 5 // (4 * rows) - (1 << 63)
        least = labelled.where(F.col("order") < F.lit(bound))
        if least.count() >= FIT_ROWS:
            labelled = least
    return labelled.orderBy("order", "doc_id").limit(FIT_ROWS)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
             path: Column | None = None, label_col: str = "quality", cut: float = 0.0) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score (0 to 1), kept: one row per row of ``df``."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                    F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    measured = stage(src.mapInPandas(_measure, f"doc_id {id_type}, host string, path string, "
                                     + ", ".join(f"{f} double" for f in FEATURES)), "features")
    good = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("good")).where("good is not null")
    labelled = measured.join(good, F.col("doc_id") == F.col("label_id")).select("doc_id", "good", *FEATURES)
    sample = _sample(stage(labelled.withColumn("order", F.xxhash64("doc_id")), "labelled")).select("good", *FEATURES).toPandas()
    w, b = fit(sample[list(FEATURES)].to_numpy(float), (sample["good"].to_numpy(float) > 0).astype(float))
    evidence = F.lit(b)
    for f, k in zip(FEATURES, w):
        evidence = evidence + F.lit(float(k)) * F.col(f)
    scored = measured.select("doc_id", "host", "path", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), evidence)).alias("evidence"))
    scored = scored.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence"))))
    paths = stage(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("path_n"), F.sum("p").alias("path_p"), F.sum(F.col("p") * F.col("p")).alias("path_pp")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_p").alias("host_p"), F.sum("path_pp").alias("host_pp"))
    hosts = stage(hosts, "hosts")
    every = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_p").alias("p")).first()
    mean = every.p / every.n if every.n else 0.5

    def inside(level: str) -> Column:
        m = F.col(f"{level}_p") / F.col(f"{level}_n")
        return F.greatest(F.lit(1e-6), F.col(f"{level}_pp") / F.col(f"{level}_n") - m * m).alias(f"{level}_v")

    host_k = _strength(hosts.select("*", inside("host")), F.lit(mean), "host_n", "host_p", "host_v")
    sites = paths.join(hosts, "host")
    path_k = _strength(sites.select("*", inside("path")), F.col("host_p") / F.col("host_n"), "path_n", "path_p", "path_v")
    # the document's own p leaves the sums before they judge it
    host_post = (F.col("host_p") - F.col("p") + F.lit(host_k * mean)) / (F.col("host_n") - F.lit(1) + F.lit(host_k))
    path_post = (F.col("path_p") - F.col("p") + F.lit(path_k) * F.col("host_posterior")) / (F.col("path_n") - F.lit(1) + F.lit(path_k))
    odds = F.col("evidence") + F.lit(SITE_WEIGHT) * (_logit(F.col("path_posterior")) - _logit(F.lit(mean)))
    return (scored.join(stage(sites, "sites"), ["host", "path"])
            .withColumn("host_posterior", host_post).withColumn("path_posterior", path_post).withColumn("odds", odds)
            .select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior",
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("odds")))).alias("score"), (F.col("odds") >= F.lit(cut)).alias("kept")))


def op4_bayes_quality_classifier(spark, sf_dir):
    """All ``documents`` with evidence, site posteriors and verdict, fitted on ``labels``."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
