"""Language identification by words first, character n-grams for the rest.

Model: how often each word occurs in each language, counted over all learning
rows, and the n-grams of all words, with a mark at either end and of 1 to
MAX_GRAM characters, weighted by the words' counts, as the fallback. Both are
tables. Workers hold all of both when there are no more than MAX_WORDS and
MAX_GRAMS; else the most frequent words, and all other words of the texts are
looked up in the tables by a join, each distinct word once, so the bounds do
not change an answer.

Score of a text: the sum over its words of the log frequency in each language.
A word that was learned gives its own; an unknown one the mean over its longest n-grams
that were learned, falling back from MAX_GRAM to 1. The answer is the language
with the highest sum (ties: alphabetical), the score its share under a softmax
of the mean log frequency per word times TEMPER.

Null and edge cases: a null text and one without letters are ``und`` with score
0; rows with a null language are never learned from; without learning rows all
are ``und``; a text in letters that the model has never seen gets the language
with most words; texts are read whole; repeated rows are predicted each; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage, unstage

MAX_WORDS = 150_000
MAX_GRAMS = 150_000
MAX_GRAM = 5
#: Longer words are known by their n-grams only.
MAX_WORD_CHARS = 40
#: Additive smoothing of counts.
SMOOTH = 0.5
TEMPER = 4.0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
#: Counts a task gathers before it hands them on, and unseen words whose score a worker keeps.
_GATHER = 400_000
_KEEP = 100_000


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Numbers that are no digits (², Ⅷ) match the pattern but are no letters."""
    out = []
    for word in _WORD.findall(text.lower()):
        if word.isalpha():
            out.append(word)
        else:
            out += "".join(c if c.isalpha() else " " for c in word).split()
    return out


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}

    def flush():
        out = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pd.DataFrame(out, columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > _GATHER:
            yield flush()
    if counts:
        yield flush()


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[tuple[str, str], int] = {}

    def flush():
        out = pd.DataFrame([(lang, g, n) for (lang, g), n in counts.items()], columns=["lang", "gram", "n"])
        counts.clear()
        return out

    for batch in batches:
        for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
            for k in range(1, MAX_GRAM + 1):
                for g in grams_of(word, k):
                    counts[lang, g] = counts.get((lang, g), 0) + n
        if len(counts) > _GATHER:
            yield flush()
    if counts:
        yield flush()


def _most_frequent(counts: DataFrame, key: str, most: int) -> pd.DataFrame:
    """Counts by language of at most ``most`` keys: those at or above a count that so many reach."""
    if not most:
        return pd.DataFrame(columns=[key, "lang", "n"])
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    levels = totals.groupBy(F.floor(F.log(F.col("total").cast("double")) * 8).alias("level")).agg(F.count(F.lit(1)).alias("keys"))
    least, room = None, most
    for r in sorted(levels.collect(), key=lambda r: -r.level):  # a few hundred levels at most
        if r["keys"] > room:
            break
        least, room = r.level, room - r["keys"]
    if least is None:
        return pd.DataFrame(columns=[key, "lang", "n"])
    per = counts.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang"))
    kept = per.where(F.floor(F.log(F.col("total").cast("double")) * 8) >= F.lit(least))
    return kept.select(key, F.explode("by_lang").alias("x")).select(key, "x.lang", "x.n").toPandas()


class Model:
    """Log frequencies of known words and n-grams by language."""

    def __init__(self, words: pd.DataFrame, grams: pd.DataFrame, totals: dict[str, int], gram_totals: dict[str, int],
                 n_words: int | None = None, n_grams: int | None = None, tables: tuple[DataFrame, DataFrame] | None = None):
        """``n_words`` and ``n_grams`` count all that were learned, which ``tables`` (lang, word or gram, n) hold."""
        self.n_words = words["word"].nunique() if n_words is None else n_words
        self.n_grams = grams["gram"].nunique() if n_grams is None else n_grams
        self.totals, self.gram_totals, self.tables = totals, gram_totals, tables
        self.langs = sorted(totals)
        self.words, self.word_logs = self._table(words, "word", totals, self.n_words)
        self.grams, self.gram_logs = self._table(grams, "gram", gram_totals, self.n_grams)
        most = max(totals.values(), default=1)
        self.prior = np.array([np.log(totals[x] / most) for x in self.langs], dtype=np.float32)
        self._seen: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}  # workers have the literal part only

    @property
    def whole(self) -> bool:
        """Whether all learned words and n-grams are in the literal part."""
        return len(self.words) == self.n_words and len(self.grams) == self.n_grams

    def _table(self, rows: pd.DataFrame, key: str, totals: dict[str, int], distinct: int):
        index: dict[str, int] = {}
        at = [index.setdefault(k, len(index)) for k in rows[key]]
        lang = {x: i for i, x in enumerate(self.langs)}
        n = np.zeros((len(index), len(self.langs)), dtype=np.float64)
        np.add.at(n, (at, [lang[x] for x in rows["lang"]]), rows["n"].to_numpy(float))
        size = np.array([totals.get(x, 0) for x in self.langs], dtype=np.float64)
        return index, np.log((n + SMOOTH) / (size + SMOOTH * (distinct + 1))).astype(np.float32)

    def unseen(self, word: str) -> list[int]:
        """Backoff: the longest n-grams of the word that are known (none: empty)."""
        got = self._seen.get(word)
        if got is None:
            find, got = self.grams.get, []
            for k in range(min(MAX_GRAM, len(word) + 2), 0, -1):
                got = [i for g in grams_of(word, k) if (i := find(g)) is not None]
                if got:
                    break
            if len(word) <= MAX_WORD_CHARS:
                if len(self._seen) >= _KEEP:
                    self._seen.clear()
                self._seen[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known, times, grams, weights, nothing = [], [], [], [], 0
        for w, n in words.items():
            i = self.words.get(w)
            if i is not None:
                known.append(i)
                times.append(n)
            elif at := self.unseen(w):  # the mean over its n-grams, n times
                grams += at
                weights += [n / len(at)] * len(at)
            else:
                nothing += n
        total = nothing * self.prior.astype(np.float64)
        if known:
            total += np.asarray(times, dtype=np.float64) @ self.word_logs[known]
        if grams:
            total += np.asarray(weights, dtype=np.float64) @ self.gram_logs[grams]
        return self.answer(total, sum(words.values()))

    def answer(self, total: np.ndarray, n: int) -> tuple[str, float]:
        best = int(np.argmax(total))
        mean = (total - total[best]) / n
        return self.langs[best], float(1 / np.exp(TEMPER * mean).sum())


def learn(rows: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """The model of all ``rows`` (text, lang)."""
    counts = (rows.where("text is not null and lang is not null").select("lang", "text")
              .mapInPandas(_count_words, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words = stage(counts, "word-counts")
    grams = stage(words.mapInPandas(_count_grams, "lang string, gram string, n long")
                  .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    totals = {r.lang: int(r.n) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_totals = {r.lang: int(r.n) for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    short = words.where(F.length("word") <= MAX_WORD_CHARS)
    n_words, n_grams = (t.select(k).distinct().count() for t, k in ((short, "word"), (grams, "gram")))
    fits = n_words <= max_words and n_grams <= max_grams  # else n-grams are looked up in their table
    return Model(_most_frequent(short, "word", max_words), _most_frequent(grams, "gram", max_grams if fits else 0), totals, gram_totals,
                 n_words, n_grams, (short, grams))


def _grams(k: int):
    """word, gram, times: the n-grams of length k of each word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word in batch["word"]:
                rows += [(word, g, n) for g, n in Counter(grams_of(word, k)).items()]
                if len(rows) > _GATHER:
                    yield pd.DataFrame(rows, columns=["word", "gram", "times"])
                    rows = []
            yield pd.DataFrame(rows, columns=["word", "gram", "times"])
    return run


def _log_columns(counts: DataFrame, key: str, langs: list[str], totals: dict[str, int], distinct: int) -> DataFrame:
    """key and l_0, l_1, ...: the log frequency in each language."""
    per = counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, x in enumerate(langs)])
    return per.select(key, *[F.log((F.col(f"n_{i}") + F.lit(SMOOTH)) / F.lit(totals.get(x, 0) + SMOOTH * (distinct + 1))).alias(f"l_{i}")
                             for i, x in enumerate(langs)])


def _looked_up(words: DataFrame, model: Model) -> DataFrame:
    """word, l_0, l_1, ... of distinct words from the tables: learned words, else their longest learned n-grams. Words without any are left out."""
    logs = [f"l_{i}" for i in range(len(model.langs))]
    known, grams = model.tables
    found = stage(_log_columns(known.join(words, "word", "left_semi"), "word", model.langs, model.totals, model.n_words), "learned-words")
    out, rest = found, stage(words.join(found, "word", "left_anti"), "unseen-words")
    for k in range(MAX_GRAM, 0, -1):  # n-grams one shorter are written only of words without a learned one so far
        parts = stage(rest.mapInPandas(_grams(k), "word string, gram string, times long"), "word-grams")
        of_length = grams.where(F.length("gram") == k).join(parts.select("gram").distinct(), "gram", "left_semi")
        asked = _log_columns(of_length, "gram", model.langs, model.gram_totals, model.n_grams)
        means = stage(parts.join(asked, "gram").groupBy("word").agg(
            *[(F.sum(F.col("times") * F.col(x)) / F.sum("times")).alias(x) for x in logs]), "word-scores")
        left = stage(rest.join(means, "word", "left_anti"), "unseen-words") if k > 1 else None
        unstage(parts)
        unstage(rest)
        out, rest = out.unionByName(means), left
    return out


def _predict_by_join(src: DataFrame, model: Model, id_type: str) -> DataFrame:
    """As ``Model.predict`` of a whole model: words outside the literal part are looked up in the tables."""
    shared = src.sparkSession.sparkContext.broadcast(model)

    def literal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            totals, sizes, rest = [], [], []
            for text in batch["text"]:
                words = Counter(words_of(text)) if text else {}
                at = {w: m.words[w] for w in words if w in m.words}
                total = np.zeros(len(m.langs))
                if at:
                    total += np.array([words[w] for w in at], dtype=np.float64) @ m.word_logs[list(at.values())]
                totals.append(total)
                sizes.append(sum(words.values()))
                rest.append([{"word": w, "times": n} for w, n in words.items() if w not in at])
            yield pd.DataFrame({"row": np.arange(row, row + len(batch)), "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "total": totals, "size": sizes, "rest": rest})
            row += len(batch)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = [m.answer(np.asarray(t) + (0 if more is None else np.asarray(more)), n) if n else (UNKNOWN, 0.0)
                   for t, more, n in zip(batch["total"], batch["more"], batch["size"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    rows = stage(src.mapInPandas(literal, f"row long, doc_id {id_type}, held_out boolean, total array<double>, size long, "
                                          "rest array<struct<word:string,times:long>>"), "literal-scores")
    each = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.times")
    scores = _looked_up(stage(each.select("word").distinct(), "other-words"), model)
    more = each.join(scores, "word", "left").groupBy(F.col("row").alias("of")).agg(F.array(*[
        F.sum(F.col("times") * F.coalesce(f"l_{i}", F.lit(float(p)))) for i, p in enumerate(model.prior)]).alias("more"))
    return rows.join(more, F.col("row") == F.col("of"), "left").select("doc_id", "held_out", "total", "size", "more").mapInPandas(
        finish, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is 2 modulo 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score. The literal part of the model goes to the workers once, as a broadcast of bounded size."""
    src = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    if model.langs and not model.whole:
        return _predict_by_join(src, model, id_type)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = [m.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    return src.mapInPandas(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op7_word_backoff_langid(spark, sf_dir):
    """The language of all ``documents``, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id")))))
