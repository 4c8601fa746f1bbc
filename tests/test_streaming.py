"""Landed-file stream: each file is merged once; neither a replay nor a lost checkpoint loses or repeats rows."""

import json
import os
import tempfile

import pytest

from cadence.operators.merge import upsert
from cadence.streaming.landed_stream import latest_snapshot, manifest_versions, merge_stream, read_manifest

LANDED = "id int, title string, author string, arrival int"
TABLE = "id int, title string, author string"


def _write(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        json.dump(rows, f)


def _merge(cur, batch):
    return upsert(cur, batch, ["id"], "arrival", ["title"])


@pytest.fixture
def run(spark):
    base = tempfile.mkdtemp(prefix="cadence-stream-")
    landed, table = os.path.join(base, "landed"), "file://" + os.path.join(base, "table")
    os.makedirs(landed)

    def go(name=os.path.basename(base)):
        merge_stream(spark, landed, LANDED, table, TABLE, _merge, ["id"], name=name).awaitTermination(120)
        return {r["id"]: (r["title"], r["author"]) for r in latest_snapshot(spark, table, TABLE).collect()}

    return landed, table, go


def test_stream_upsert_and_replay(spark, run):
    landed, table, go = run
    _write(landed, "a.json", [{"id": 1, "title": "a", "author": "x", "arrival": 1},
                              {"id": 2, "title": "b", "author": "y", "arrival": 2}])
    assert go() == {1: ("a", "x"), 2: ("b", "y")}
    _write(landed, "b.json", [{"id": 1, "title": "a2", "author": "z", "arrival": 3}])
    assert go() == {1: ("a2", "x"), 2: ("b", "y")}
    before = manifest_versions(spark, table)
    assert go() == {1: ("a2", "x"), 2: ("b", "y")}
    assert manifest_versions(spark, table) == before


def test_lost_checkpoint_keeps_all_rows(spark, run):
    landed, table, go = run
    _write(landed, "a.json", [{"id": 1, "title": "a", "author": "x", "arrival": 1}])
    go()
    _write(landed, "b.json", [{"id": 2, "title": "b", "author": "y", "arrival": 1}])
    assert go(name=os.path.basename(landed) + os.path.basename(table) + "-fresh-" + os.path.basename(os.path.dirname(landed))) == \
        {1: ("a", "x"), 2: ("b", "y")}


def test_only_touched_buckets_are_rewritten(spark, run):
    landed, table, go = run
    _write(landed, "a.json", [{"id": i, "title": "a", "author": "x", "arrival": 1} for i in range(200)])
    go()
    first = {r.bucket: r.path for r in read_manifest(spark, table) if r.path}
    _write(landed, "b.json", [{"id": 7, "title": "new", "author": "z", "arrival": 2}])
    rows = go()
    second = {r.bucket: r.path for r in read_manifest(spark, table) if r.path}
    assert len(rows) == 200 and rows[7] == ("new", "x")
    assert sum(second[b] != first[b] for b in first) == 1 and set(first) == set(second)


def test_two_streams_keep_both_batches(spark, run):
    """While the first stream merges, a second one publishes the number that the first has picked."""
    landed, table, go = run
    other = landed + "-other"
    os.makedirs(other)
    _write(landed, "a.json", [{"id": 1, "title": "a", "author": "x", "arrival": 1}])
    _write(other, "b.json", [{"id": 1, "title": "b", "author": "y", "arrival": 2}, {"id": 2, "title": "c", "author": "z", "arrival": 2}])
    merges = []

    def slow(cur, batch):
        merges.append(1)
        if len(merges) == 1:
            merge_stream(spark, other, LANDED, table, TABLE, _merge, ["id"], name=os.path.basename(os.path.dirname(landed)) + "-2").awaitTermination(120)
        return _merge(cur, batch)

    merge_stream(spark, landed, LANDED, table, TABLE, slow, ["id"], name=os.path.basename(os.path.dirname(landed)) + "-1").awaitTermination(120)
    rows = {r["id"]: (r["title"], r["author"]) for r in latest_snapshot(spark, table, TABLE).collect()}
    assert rows == {1: ("a", "y"), 2: ("c", "z")} and len(merges) == 2
    assert manifest_versions(spark, table) == [1, 2]
