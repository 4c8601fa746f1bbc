import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cadence.llm import byte_bpe as B
from cadence.llm.tokens import read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def check(reference, df, rows, **kw):
    out = B.encode_decode(df, **kw).collect()
    assert len(out) == len(rows)
    left = [(i, t or "") for i, t in rows]
    for r in out:
        text = bytes(r.decoded).decode()
        left.remove((r.doc_id, text))  # exact round trip
        assert r.ids == reference.encode_ordinary(text)
        assert bytes(r.ids_bytes) == np.asarray(r.ids, "<u4").tobytes()
    assert not left


def test_edges_and_bound(docs_of, reference):
    rng = random.Random(7)
    texts = [None, "", " ", "\n\n  x", "don't  we'll", "é à", "日本語　x", "🙂🙂 z", "a" * 700, "x\x85y\xa0z w", "\x1c\x1d a", "<|endoftext|>",
             "İstanbul ǅ ß", "1²½ ٣", "word " * 50, "\t\t\n \r\n", "aéb" * 90]
    texts += ["".join(rng.choice("ab é'\n1!z  ") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, None), (None, "null id")]
    df = docs_of(rows).selectExpr("*", "1 as words", "2 as ids", "3 as word", "4 as n")
    check(reference, df, rows)
    check(reference, df, rows, max_words=3)


def test_empty(docs_of):
    assert B.encode_decode(docs_of([])).count() == 0


def test_query(spark, small_docs, reference):
    got = {r.doc_id: r for r in B.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = small_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_a_match_without_a_break_does_not_cost_its_square(docs_of, reference):
    """A block of 200,000 letters; the fold over arrays needed as many steps, each over all pieces."""
    import time

    text = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.monotonic()
    check(reference, docs_of([(1, text)]), [(1, text)])
    assert time.monotonic() - began < 60


def test_matches_fold_by_pairs_of_ids_as_by_bytes():
    """A pair of ids stands for the bytes of both, whatever pieces they come from; the heap works on bytes."""
    ranks = read_ranks(PATH)
    pairs, rng = B.Pairs(ranks), random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("etaoinshrdlué日0") for _ in range(rng.randint(1, 16))).encode()
        assert B.fold(word, ranks, pairs) == B.fold(word, ranks)
