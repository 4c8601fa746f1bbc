import math
import random
import re
from collections import Counter, defaultdict

import pytest

from cadence.llm import quality_rules as Q
from cadence.llm.text_stats import base_counts, window_names, word_ids


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def random_text(rng, n):
    return "".join(rng.choice(["a", "b", "é#", "word", "\x1c", "x|y"]) + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b", "\xa0"])
                   for _ in range(n))


EDGES = [None, "", " ", "\n\n", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\nx\n\n\nx", "\x0c\n\x0c", "a\r\na\r\n"]


def test_counts_by_brute_force():
    rng = random.Random(0)
    for text in EDGES + [random_text(rng, n) for n in list(range(40)) + [300] * 20]:
        assert base_counts(text) == brute_counts(text), text


def test_window_names_without_overflow():
    rng = random.Random(1)
    words = [str(rng.randint(0, 9000)).encode() for _ in range(20000)]
    words += words[500:600] + [b"q"] * 20
    ids, distinct = word_ids(words)
    assert distinct ** 5 > 1 << 62
    names = window_names(ids, distinct)
    tuples = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    assert len(set(names.tolist())) == len(set(tuples)) == len(set(zip(names.tolist(), tuples)))


def fences(values, slack):
    q = [sorted(values)[max(1, math.ceil(len(values) * p)) - 1] for p in Q.QUARTILES]
    return q


def test_sketch_is_mergeable_and_accurate(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice("ab"), 0.0 if rng.random() < 0.1 else rng.lognormvariate(0, 2)) for g in ("x", "y") for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, part string, v double")
    whole = {r.g: r for r in Q.quantiles(Q.sketch(df, ["g"], ["v"]), ["g"]).collect()}
    merged = {r.g: r for r in Q.quantiles(Q.merge(Q.sketch(df, ["g", "part"], ["v"]), ["g"]), ["g"]).collect()}
    assert whole == merged
    for g, r in whole.items():
        exact = fences([v for k, _, v in rows if k == g], 0)
        for got, want in zip((r.q_0, r.q_1, r.q_2), exact):
            assert abs(got - want) <= 1.0001 * Q.ACCURACY * want


@pytest.fixture(scope="module")
def corpus(docs_of):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        word = (lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))))
        sep = " " if i % 30 else "# "
        rows.append((i, sep.join(word() for _ in range(rng.randint(12, 90))), rng.choice(["en", "de", None]), f"s{i % 3}" if i < 800 else "rare"))
    rows += [(1000 + i, t, "en", "s0") for i, t in enumerate(EDGES)] + [(0, "x", "xx", None)]
    return rows, Q.apply_rules(docs_of(rows)).collect()


def test_query_by_brute_force(corpus):
    rows, out = corpus
    assert len(out) == len(rows)
    by_key = defaultdict(list)
    for r in rows:
        c = brute_counts(r[1])
        w = max(c[0], 1)
        lines = 1 + r[1].count("\n") if r[1] else 1
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        by_key[r[0], c].append((failed, r[2], r[3], {"word_length": c[1] / w, "symbol_ratio": c[2] / w, "dup_line_ratio": c[3] / lines,
                                                     "repeat_ratio": c[4] / w, "n_words": c[0]}))
    passed = [m for v in by_key.values() for m in v if not m[0]]

    def quart(sel, metric):
        v = [m[3][metric] for m in passed if sel(m)]
        return v

    for r in out:
        failed, lang, source, m = by_key[r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)][0]
        assert r.base_failed == failed
        for sel in (lambda x: x[1:3] == (lang, source), lambda x: x[1] == lang, lambda x: True):
            if len(quart(sel, "n_words")) >= Q.MIN_GROUP:
                break
        keep = not failed
        sure = True
        for k, slack in Q.SLACK.items():
            q0, q1, q2 = fences(quart(sel, k), slack)
            reach = max(slack, Q.REACH * min(q1 - q0, q2 - q1)) * math.sqrt(max(1.0, fences(quart(sel, "n_words"), 0)[1] / max(m["n_words"], 1)))
            off = 0.1 * reach + 0.02 * q1  # the sketch is accurate to a hundredth
            sure = sure and abs(m[k] - (q1 + reach)) > off and abs(m[k] - (q1 - reach)) > off
            keep = keep and m[k] <= q1 + reach and (k != "word_length" or m[k] >= q1 - reach)
        if sure:
            assert r.kept == keep, (r, lang, source)
    assert {r.kept for r in out} == {True, False}


def test_empty_and_clashing_columns(docs_of):
    assert Q.apply_rules(docs_of([])).count() == 0
    df = docs_of([(1, "a b c")]).selectExpr("*", "1 as n_words", "2 as kept", "3 as metric", "4 as bucket", "5 as n")
    assert Q.apply_rules(df).first().n_words == 3


def test_separates_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    out = Q.op1_adaptive_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    r = out.selectExpr("avg(if(quality = 1 and n_words >= 10, int(kept), null)) as good", "avg(if(quality = 0, int(kept), null)) as bad").first()
    assert r.good > 0.95 and r.bad < 0.15


def test_language_and_source_decide_for_ratios_that_are_mostly_zero(docs_of):
    rng = random.Random(7)

    def text(symbols, repeats=0):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(100)]
        for k in rng.sample(range(100), symbols):
            w[k] += "#"
        return " ".join(w + w[:repeats])

    rows = [(i, text(0), "en", "clean") for i in range(300)] + [(1000 + i, text(8), "en", "clean") for i in range(5)]
    rows += [(2000 + i, text(i % 6), "en", "code") for i in range(300)] + [(3000 + i, text(8), "en", "code") for i in range(5)]
    rows += [(4000, text(1), "en", "clean"), (4001, text(0, 9), "en", "clean"), (4002, text(0, 5), "en", "clean")]
    out = {r.doc_id: r for r in Q.apply_rules(docs_of(rows)).collect()}
    assert not any(out[1000 + i].kept for i in range(5)) and all(out[3000 + i].kept for i in range(5))
    assert all(out[i].kept for i in [*range(300), *range(2000, 2300)])
    assert out[4000].kept and out[4002].kept
    assert out[4001].repeat_ratio > out[4001].repeat_ratio_max
