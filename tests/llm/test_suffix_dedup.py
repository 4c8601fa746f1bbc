import hashlib
import random

import numpy as np
import pytest

from cadence.llm import suffix_dedup as S
from cadence.llm.suffix_buckets import anchors, names_at, refine


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking up every string of ``length`` bytes."""
    docs = sorted({(i is None, i, t or "") for i, t in rows}, key=lambda d: (d[0], d[1] or 0, d[2]))
    seen, out = set(), {}
    for d in docs:
        data = d[2].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[d[1], d[2]] = (d[1], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[i, t or ""] for i, t in rows), key=str)


def run(docs_of, rows, **kw):
    out = S.remove_repeats(docs_of(rows), **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "andy", "b", "stone", "ß", "windmill"]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 90)))
                 for _ in range(rng.randint(0, 6))]
        text = "\n".join(parts)
        if rng.random() < 0.1:
            text = rng.choice(vocab + [" "]) * rng.randint(1, 300)
        if rows and rng.random() < 0.15:
            text = rng.choice(rows)[1] or ""
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(["", "X"]) + text[cut:]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(docs_of, seed):
    rows = corpus(seed) + [(7000, None), (7001, ""), (7002, "x" * 99), (7003, "x" * 100), (7004, "x" * 250), (7005, "y" * 100 + "x" * 130)]
    assert run(docs_of, rows) == brute(rows, 100)


def test_split_buckets_lose_nothing(docs_of):
    rows = corpus(3, 80)
    assert run(docs_of, rows, length=30, gram=10, split=5) == brute(rows, 30)


def test_null_and_identical_rows(docs_of):
    text = "a passage of text that is longer than one hundred bytes, so that a copy of it has to be removed from a later row"
    rows = [(None, text), (3, "x " + text), (3, "x " + text), (1, "y"), (9, "ü" * 60 + text)]
    assert run(docs_of, rows) == brute(rows, 100)


def test_repeated_id_with_other_text(docs_of):
    text = "a passage of text that is longer than one hundred bytes, so that a copy of it has to be removed from a later row"
    out = run(docs_of, [(5, text + " one"), (5, "two " + text), (5, None)])
    assert sorted(r[2] > 0 for r in out) == [False, False, True]


def test_query_at_sf0001(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    out = S.op2_bucket_pointer_dedup(spark, "/root/testdata/sf0.001").collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == brute(rows, 100)


def test_empty_and_clashing_columns(docs_of):
    assert S.remove_repeats(docs_of([])).count() == 0
    df = docs_of([(1, "z" * 300)]).selectExpr("*", "1 as doc", "2 as pos", "3 as gram", "4 as spans", "5 as version", "6 as n")
    assert S.remove_repeats(df).first().n_removed == 299


def test_equal_strings_share_an_anchor():
    rng = np.random.default_rng(0)
    for _ in range(30):
        core = rng.integers(97, 100 if _ % 2 else 97 + 26, 100, dtype=np.uint8)
        at = []
        for _ in range(2):
            pre, post = rng.integers(97, 123, rng.integers(0, 200), dtype=np.uint8), rng.integers(97, 123, rng.integers(0, 200), dtype=np.uint8)
            p, _h, _a, _b = anchors(np.concatenate([pre, core, post]), 100, 32)
            at.append({int(x) - len(pre) for x in p if 0 <= x - len(pre) <= 68})
        assert at[0] & at[1]


def test_long_text_in_pieces(monkeypatch):
    from cadence.llm import suffix_buckets as B
    data = np.random.default_rng(1).integers(0, 4, 5000, dtype=np.uint8)
    whole = anchors(data, 100, 32)
    monkeypatch.setattr(B, "_PIECE", 700)
    cut = anchors(data, 100, 32)
    assert all((x == y).all() for x, y in zip(whole, cut))


def test_refine_sorts_and_names():
    rng = np.random.default_rng(2)
    context = rng.integers(0, 2, (200, 21), dtype=np.uint8)
    bucket = rng.integers(0, 3, 200)
    order, rank, common = refine(bucket, context)
    keys = [(bucket[i], context[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for depth in (0, 1, 5, 21):
        names = names_at(order, common, depth)
        pairs = {(int(bucket[i]), context[i, :depth].tobytes(), int(names[i])) for i in range(200)}
        assert len(pairs) == len({p[:2] for p in pairs}) == len({p[2] for p in pairs})
