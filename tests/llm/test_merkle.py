import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadence.llm.merkle import build, fold, op12_merkle_manifest
from cadence.llm.registry import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    out = ""
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def tree(level):
    levels = [level]
    while len(level) > 1:
        level = [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        levels.append(level)
    return levels


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"], leaf(r), r["n_chars"], r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([d[2] for d in sorted(groups[x], key=lambda d: d[:3] if d[0] else (False, 0, d[2]))]) for x in langs}
    forest = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, d in enumerate(sorted(groups[x], key=lambda d: d[:3] if d[0] else (False, 0, d[2]))):
            r, siblings = d[4], []
            at = d[2]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                at = leaf({**r, "n_chars": r["n_chars"] + 1})
            for levels, j in ((trees[x], i), (forest, k)):
                for level in levels[:-1]:
                    other = level[j ^ 1] if j ^ 1 < len(level) else ""
                    siblings.append(other)
                    at = h(at + other if j % 2 == 0 else other + at)
                    j //= 2
            out.append((r["doc_id"], d[2], trees[x][-1][0], forest[-1][0], h("".join(siblings)), at, at == forest[-1][0]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, extra=""):
        df = spark.createDataFrame(rows, SCHEMA)
        df.selectExpr("*", *([extra] if extra else [])).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return op12_merkle_manifest(spark, str(tmp_path))
    return go


def docs(n, lang=lambda i: "en"):
    return [dict(doc_id=i, text=f"text {i}", lang=lang(i), source="s", n_chars=6) for i in range(n)]


@pytest.mark.parametrize("n", [1, 257])
def test_sizes(run, n):
    rows = docs(n)
    assert result(run(rows)) == brute(rows)


def test_nulls_ties_repeats_clashing_columns(run):
    rows = docs(40, lambda i: [None, "en", "é", "Z", "", "a-very-long-name"][i % 6])
    rows += [dict(doc_id=None, text=None, lang=None, source=None, n_chars=None)] * 2
    rows += [dict(doc_id=None, text="", lang="en", source="", n_chars=0), dict(doc_id=7, text="other", lang="en", source="s", n_chars=None),
             dict(doc_id=7, text="x" * 300_000, lang="en", source="s", n_chars=3)] + [rows[3]] * 5
    assert result(run(rows, "1 as digest")) == brute(rows)


def test_tampered_rows_fail(run):
    got = {r.doc_id: r.verified for r in run(docs(300)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(300)}


def test_empty(run):
    assert run([]).count() == 0


def test_stride_does_not_matter(spark, small_docs):
    want = None
    for stride in (2, 8):
        manifest = build(small_docs, stride=stride)
        got = sorted(map(tuple, manifest.proofs().select("doc_id", "leaf", "root", F.array_join("path", " ")).collect()))
        assert got[0][2] == manifest.root()
        want = want or got
        assert got == want


def test_many_parts(spark, small_docs):
    """A language that holds nearly all rows lies in several parts of the range partitioning."""
    rows = docs(5000, lambda i: "de" if i % 50 == 0 else "en")
    proofs = build(spark.createDataFrame(rows, SCHEMA).repartition(7)).proofs()
    folded = proofs.select("doc_id", "leaf", "root", fold(F.col("leaf"), F.col("path")).alias("folded"))
    assert folded.where("folded <> root").count() == 0
    assert {r.root for r in folded.select("root").distinct().collect()} == {brute(rows)[0][3]}


def test_same_as_sql(compare):
    got, want = compare("op12_merkle_manifest")
    assert got == want


def test_registered():
    assert queries()["op12_merkle_manifest"] is op12_merkle_manifest
