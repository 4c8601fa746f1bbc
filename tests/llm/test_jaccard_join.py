import random
import re

import numpy as np
import pytest

from cadence.llm import jaccard_join as J
from cadence.llm.components import components
from cadence.llm.shingles import PrefixTree, rank_sets


def brute_sets(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(rows, num=90, den=100):
    sets = [brute_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for members in groups.values():
        for i in members:
            least[i] = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
    return sorted(((r[0], len(sets[i]), least[i]) for i, r in enumerate(rows)), key=str)


def corpus(seed, families=12, copies=14, words=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 9, 11, 19, 21, 40, words, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            if rng.random() < 0.3:
                text = text[:-1]
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(text).title() if rng.random() < 0.3 else " ".join(text)))
    rng.shuffle(rows)
    return rows


def check(docs_of, rows, **kw):
    got = sorted((tuple(r) for r in J.join_groups(docs_of(rows), **kw).collect()), key=str)
    assert got == brute(rows)


def test_oracle(compare):
    got, want = compare("op9_prefix_tree_jaccard")
    assert got == want


def test_brute_force_and_edges(docs_of):
    rows = corpus(1) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "É x"), (9007, "é x"),
                        (None, "null id text here"), (9008, "null id text here"), (5, "repeated id text"), (9009, "w1 " * 3000)]
    check(docs_of, rows)


def test_blocks_of_large_components_lose_nothing(docs_of):
    check(docs_of, corpus(2, families=3, copies=40), block=400)


def test_empty_and_clashing_columns(docs_of):
    assert J.join_groups(docs_of([])).count() == 0
    df = docs_of([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 as node", "2 as comp", "3 as n", "4 as part", "5 as root")
    assert {r.component_id for r in J.join_groups(df).collect()} == {1}


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_exactly_the_links(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(60):
        base = set(rng.sample(range(200), rng.randint(1, 60)))
        for _ in range(rng.randint(1, 5)):
            s = set(base)
            for _ in range(rng.randint(0, 4)):
                s.add(rng.randrange(200))
            if len(s) > 1:
                s.discard(rng.choice(sorted(s)))
            sets.append(np.array(sorted(s), dtype=np.uint64))
    ranked, vocabulary = rank_sets(sets)
    tree = PrefixTree(ranked, vocabulary)
    for q in ranked:
        got = sorted(tree.search(q, 8, 10))
        want = [i for i, y in enumerate(ranked) if 10 * len(np.intersect1d(q, y)) >= 8 * len(np.union1d(q, y))]
        assert got == want


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(0)
    for n in [*range(9, 60), 200, 999]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(4):
            drop = rng.integers(0, max(1, n // 10) + 1)
            extra = rng.integers(0, 1 << 63, max(0, (n // 10 - drop) // 2), dtype=np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], extra]))
            if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) and len(a) != len(b):
                assert set(J.part_names(a, 90, 100)) & set(J.part_names(b, 90, 100))


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
