import hashlib
import random

from cadence.llm.exact_dedup import exact_groups, text_identities

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    norm = [(t or "").translate(SPACE) for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        group = [(-len(u or ""), j is None, j) for (j, u), m in zip(rows, norm) if m == n]
        c, _, keep = min(group)
        out.append((i, keep, len(group), i == keep and len(t or "") == -c, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs_of, rows):
    got = sorted((tuple(r) for r in exact_groups(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)


def test_oracle(compare):
    got, want = compare("op6_block_naming_dedup")
    assert got == want


def test_edges(docs_of):
    rng = random.Random(1)
    long = "".join(rng.choice("abcé \n") for _ in range(40_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "ab"), (5, "a\x0bb "), (5, "a\x0bb "), (5, "other"),
            (6, long), (7, long.replace(" ", "  ")), (8, long[:-1] + "X"), (9, "X" + long), (10, "ab\x1c"), (None, "zz"),
            (11, "zz"), (12, "é" * 4096), (13, "é" * 4096 + "é"), (14, "é" * 2048), (15, "é" * 2048)]
    check(docs_of, rows)
    assert exact_groups(docs_of([])).count() == 0


def test_hot_group(docs_of):
    rows = [(i, "hot text") for i in range(700)] + [(1000 + i, f"cold {i % 150}") for i in range(300)]
    check(docs_of, rows)


def test_names_separate_all_block_sequences(docs_of):
    # every text over {a,b} of up to 7 blocks of one byte
    texts = [""] + [format(i, f"0{n}b").replace("0", "a").replace("1", "b") for n in range(1, 8) for i in range(2**n)]
    df = docs_of(list(enumerate(texts)))
    names = text_identities(df, "doc_id", "text", block=1).collect()
    assert len(names) == len(texts) == len({(r.level, r.name) for r in names})


def test_extra_columns(docs_of):
    df = docs_of([(1, "a"), (2, "a ")]).selectExpr("*", "1 as name", "2 as idx", "3 as block", "4 as key", "5 as kept")
    assert {(r.doc_id, r.kept) for r in exact_groups(df).collect()} == {(1, False), (2, True)}
