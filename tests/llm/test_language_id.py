import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadence.llm import language_id as L

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang", "text").collect()


def test_held_out_accuracy_and_brute_force(spark, rows):
    out = {r.doc_id: r for r in L.op7_word_backoff_langid(spark, D).collect()}
    assert len(out) == len(rows)
    for r in rows:
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    test = [r for r in rows if out[r.doc_id].held_out]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    # the same model, counted in plain Python (all words and n-grams fit the bounds here)
    words, grams = Counter(), Counter()
    for r in rows:
        if not out[r.doc_id].held_out:
            words.update((w, r.lang) for w in L.words_of(r.text))
    for (w, lang), n in words.items():
        for k in range(1, L.MAX_GRAM + 1):
            for g in L.grams_of(w, k):
                grams[g, lang] += n
    langs = sorted({x for _, x in words})
    known, seen = {w for w, _ in words if len(w) <= L.MAX_WORD_CHARS}, {g for g, _ in grams}
    size = {x: sum(n for (_, y), n in words.items() if y == x) for x in langs}
    gsize = {x: sum(n for (_, y), n in grams.items() if y == x) for x in langs}

    def logs(w):
        if w in known:
            return [math.log((words[w, x] + L.SMOOTH) / (size[x] + L.SMOOTH * (len(known) + 1))) for x in langs]
        for k in range(min(L.MAX_GRAM, len(w) + 2), 0, -1):
            found = [g for g in L.grams_of(w, k) if g in seen]
            if found:
                return [sum(math.log((grams[g, x] + L.SMOOTH) / (gsize[x] + L.SMOOTH * (len(seen) + 1))) for g in found) / len(found)
                        for x in langs]
        return [math.log(size[x] / max(size.values())) for x in langs]

    for r in test[:80]:
        c = Counter(L.words_of(r.text))
        total = [sum(n * logs(w)[i] for w, n in c.items()) for i in range(len(langs))]
        assert out[r.doc_id].lang_pred == langs[total.index(max(total))]
        mean = [(t - max(total)) / sum(c.values()) for t in total]
        assert math.isclose(out[r.doc_id].score, 1 / sum(math.exp(L.TEMPER * m) for m in mean), rel_tol=1e-3)


def test_backoff_and_bounds(docs_of):
    rows = [(i, "the cat sat here", "en") for i in range(30)] + [(50 + i, "der hund saß dort", "de") for i in range(20)]
    docs = docs_of(rows)
    model = L.learn(docs.select("text", "lang"))
    assert model.predict("xhundx")[0] == "de" and model.predict("catty")[0] == "en"
    assert model.predict("жжж")[0] == "en"  # nothing known: the language with most words
    small = L.learn(docs.select("text", "lang"), max_words=4, max_grams=10)
    assert len(small.words) <= 4 and len(small.grams) <= 10
    assert small.predict("the cat")[0] == "en" and small.predict("der hund")[0] in ("de", "en")


def test_edges(spark, docs_of):
    rows = [(1, "the cat", "en"), (2, None, "en"), (3, "", "en"), (4, "12 !?", "en"), (5, "x " * 60000, None), (1, "the cat", "en"),
            (None, "the", "en"), (6, "a" * 5000, "de")]
    docs = docs_of(rows).selectExpr("*", "1 as word", "2 as score", "3 as held_out")
    out = L.predict(docs, L.learn(docs.where("not " + "doc_id <=> 99"))).collect()
    assert len(out) == len(rows)
    assert sorted(r.doc_id for r in out if r.lang_pred == "und") == [2, 3, 4] and all(r.score == 0 for r in out if r.lang_pred == "und")
    empty = docs_of([])
    assert L.predict(empty, L.learn(empty)).count() == 0
    assert {r.lang_pred for r in L.predict(docs, L.learn(empty)).collect()} == {"und"}
    assert docs.where(L.held_out(F.col("doc_id"))).count() >= 0


def test_bounds_do_not_change_answers(spark, docs_of):
    rows = [(i, "the cat sat here", "en") for i in range(30)] + [(50 + i, "der hund saß dort", "de") for i in range(20)]
    rows += [(100, "der hund", None), (101, "xhundx der catty", None), (102, "жжж", None), (103, "12", None), (103, None, None), (None, "hund", None)]
    docs = docs_of(rows)
    learned = docs.select("text", "lang")
    small = L.learn(learned, max_words=4, max_grams=10)
    assert not small.whole
    got, want = ({(r.doc_id, r.score == 0): r for r in L.predict(docs, m).collect()} for m in (small, L.learn(learned)))
    assert got.keys() == want.keys() and got[100, False].lang_pred == "de"
    for k, r in want.items():
        assert (got[k].lang_pred, got[k].held_out) == (r.lang_pred, r.held_out) and math.isclose(got[k].score, r.score, rel_tol=1e-3, abs_tol=1e-6)
    some = spark.read.parquet(f"{D}/documents.parquet").limit(300)
    models = L.learn(some.select("text", "lang"), 500, 500), L.learn(some.select("text", "lang"))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 3)) for r in L.predict(some, m).collect()} for m in models)
    assert a == b


def test_numbers_that_are_no_digits_are_no_letters(spark, docs_of):
    rows = docs_of([(i, "the cat and the dog", "en") for i in range(40)] + [(50, "²½Ⅷ ①", "en"), (51, "the² cat½", "en"), (52, "½", None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(rows, L.learn(rows)).collect()}
    assert got[50] == got[52] == ("und", 0.0) and got[51][0] == "en"
