import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadence.llm.packing import pack, place, schedule
from cadence.llm.tokens import encoder


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "\n a", "don't we'll  they're", "é à b", "1 2  3\t4 ",
         "a\x1cb \x1c c", "zz" * 300, "<|endoftext|> ok", "日本 語 　 x", "tab\t x \t y", "a b\n", "a b \nc", "🙂 🙂🙂 x"]


def test_ids_as_tokenizers(hf, small_docs):
    enc = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "the", "é", "'s", "9", "!", " "]) for _ in range(30)) for _ in range(300)]
    for text in TEXTS + mixed + [r.text for r in small_docs.limit(40).collect()]:
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == hf.encode(text, add_special_tokens=False).ids, text


def check(rows, out, hf, sequence):
    want = Counter()
    docs = defaultdict(list)
    for i, t in ((r[0], r[1]) for r in rows):
        ids = hf.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] += len(ids)
        docs[i].append(ids)
    fill = defaultdict(list)
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
        fill[r.sequence_id].append((r.offset, r.length))
        slices = [d[r.start:r.start + r.length] for d in docs[r.doc_id] if len(d) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(np.asarray(s, "<u4").tobytes()) for s in slices}
    assert got == want
    last = max(fill, default=None)
    for s, parts in fill.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == sequence or s == last
    assert sorted(fill) == list(range(len(fill)))


def test_every_token_once_and_mixture(docs_of, hf):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "c", "delta's"]) for _ in range(rng.randint(0, 60))), "en",
             "big" if i % 3 else f"s{i % 4}") for i in range(400)]
    rows += [(1000, None, "en", None), (1001, "", "en", "s1"), (1001, "", "en", "s1"), (1002, "w " * 3000, "en", "s2")]
    out = pack(docs_of(rows), sequence=32, window=320).collect()
    check(rows, out, hf, 32)
    total = Counter()
    for r in out:
        total[r.queue] += r.length
    n = sum(total.values())
    window = defaultdict(Counter)
    for r in out:
        window[r.window_id][r.queue] += r.length
    for w, c in window.items():
        if sum(c.values()) == 320:
            assert all(abs(c[q] - 320 * total[q] / n) < 2 for q in total)


def test_targets_and_phases(docs_of, hf):
    rows = [(i, "one two three four", "en", "a" if i % 2 else "b") for i in range(300)]
    out = pack(docs_of(rows), sequence=16, window=64, targets={"a": 3, "b": 1}).collect()
    check(rows, out, hf, 16)
    first = Counter()
    for r in out:
        if r.window_id == 0:
            first[r.queue] += r.length
    assert first == {"a": 48, "b": 16}


def test_schedule_carries_deficits():
    phases = schedule({"a": 10, "b": 7, "c": 1}, {"a": 1, "b": 1, "c": 1})
    seen = {}
    for q, n in (("a", 10), ("b", 7), ("c", 1)):
        for start, length, y, _ in place(phases, q, 0, n, 4, 2):
            for k in range(length):
                assert y + k not in seen
                seen[y + k] = (q, start + k)
    assert sorted(seen) == list(range(18))


def test_empty_and_clashing_columns(docs_of):
    assert pack(docs_of([])).count() == 0
    df = docs_of([(1, "a b")]).selectExpr("*", "1 as queue", "2 as n", "3 as ids", "4 as task", "5 as base")
    assert pack(df).count() == 1


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "x\n<|endoftext|>\n y ", "a<|endoftext|>b <|endoftext| > c"]


def test_added_token_as_tokenizers_by_default(docs_of):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in TEXTS + ADDED:
        assert np.frombuffer(enc.encode_added(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    rows = [(i, t, "en", "s") for i, t in enumerate(ADDED)]
    check(rows, pack(docs_of(rows)).collect(), plain, 1024)


def test_hundreds_of_sources_and_targets(docs_of, hf):
    rng = random.Random(9)
    rows = [(i, "one two three four " * (1 + i % 3), "en", f"s{rng.randrange(150):03}") for i in range(3000)]
    out = pack(docs_of(rows), sequence=256, window=2048).collect()
    check(rows, out, hf, 256)
    total, window = Counter(), defaultdict(Counter)
    for r in out:
        total[r.queue] += r.length
        window[r.window_id][r.queue] += r.length
    assert set(total) == {r[3] for r in rows} and len(total) == 150
    n = sum(total.values())
    full = [c for c in window.values() if sum(c.values()) == 2048]
    assert full and all(abs(c[q] - 2048 * total[q] / n) < 2 for c in full for q in total)
    wanted = {f"s{k:03}": 3.0 if k >= 100 else 1.0 for k in range(150)}
    first = Counter()
    for r in pack(docs_of(rows), sequence=125, window=250, targets=wanted).collect():
        if r.window_id == 0:
            first[r.queue] += r.length
    assert all(abs(first[q] - 250 * w / 250) < 2 for q, w in wanted.items())
