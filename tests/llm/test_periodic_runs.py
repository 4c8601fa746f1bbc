import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from cadence.llm.periodic_runs import _split_one, collapse, find_runs, op13_periodic_runs, periodic_runs, split_rare, _neighbours

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                               "collapsed_sha256").collect()), key=str)


def runs_of(texts):
    return [list(zip(s.tolist(), n.tolist(), q.tolist())) for _, s, n, q in find_runs(texts)]


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 12])
def test_random_words_against_brute_force(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        w = [rng.choice("abcdefghijklmnopq"[:letters]) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):  # repeats of a stretch
            if w:
                i = rng.randrange(len(w))
                w[i:i] = w[i:i + rng.randrange(1, 12)] * rng.randrange(1, 6)
        texts.append(" ".join(w).encode())
    assert runs_of(texts) == [brute_runs(t.split()) for t in texts]


def test_words_of_fibonacci_and_thue_morse():
    fib, morse = ["a", "ab"], "0"
    while len(fib[-1]) < 800:
        fib.append(fib[-1] + fib[-2])
    while len(morse) < 512:
        morse += morse.translate({48: 49, 49: 48})
    texts = [" ".join(fib[-1][:800]).encode(), " ".join(morse).encode(), b"x " * 500, b" ".join([b"a b c"] * 100)]
    assert runs_of(texts) == [brute_runs(t.split()) for t in texts]


def test_splitting_is_stable_and_both_ways_agree():
    rng = random.Random(5)
    for _ in range(60):
        codes = np.array([rng.randrange(rng.choice([3, 20, 60])) for _ in range(rng.randrange(1, 400))])
        got = split_rare(codes, np.array([0]))
        before, after = (x.tolist() for x in _neighbours(codes))
        assert got == sorted(_split_one(before, after, 0, len(codes), 12))
        for s, e in got:
            assert e - s >= 12 and min(np.bincount(codes[s:e])[codes[s:e]]) >= 2


def test_deep_splitting_and_long_texts_end_soon():
    chain = [x for i in range(60_000) for x in (f"x{i + 1}", f"x{i}")]  # every word that goes makes one more rare
    rng = random.Random(3)
    two = " ".join(rng.choice("ab") for _ in range(200_000)).encode()
    began = time.time()
    found = runs_of([" ".join(chain).encode(), two, b"same " * 200_000])
    assert found[0] == [] and len(found[1]) > 1000 and found[2] == [(0, 200_000, 1)]
    assert time.time() - began < 60


def test_collapse():
    (words, *runs), = find_runs([b"q " + b"a b c " * 5 + b"z"])
    assert collapse(words, *runs) == b"q a b c z"


def test_edge_rows(spark, tmp_path):
    ten = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    long = " ".join(f"w{i % 997}" for i in range(5000))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "a " * 13, 0), (4, "a b " * 12, 0), (5, "é " * 11, 0), (6, "a " * 12, 0), (6, "a " * 12, 0),
            (ten[0], None, 0), (ten[1], "", 0), (ten[2], "one", 0), (ten[3], " ".join(f"w{i}" for i in range(50)), 0), (ten[4], long, 0), (7, long, 0),
            (ten[5], "a  b\x0bc d " * 9, 0)]
    df = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in rows], SCHEMA).selectExpr("*", "1 as start", "2 as runs")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op13_periodic_runs(spark, str(tmp_path))) == sorted((brute_row(i, t) for i, t, _ in rows), key=str)
    assert periodic_runs(df.where("false")).count() == 0


def test_whole_table_against_brute_force(spark, small_docs):
    want = sorted((brute_row(r.doc_id, r.text) for r in small_docs.where("length(text) < 8000").collect()), key=str)
    got = rows_of(op13_periodic_runs(spark, "/root/testdata/sf0.001"))
    ids = {w[0] for w in want}
    assert [g for g in got if g[0] in ids] == want and any(w[1] for w in want)


def test_same_as_sql(compare):
    got, want = compare("op13_periodic_runs")
    assert got == want
