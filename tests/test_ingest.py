"""Merges, checkpoint log and landed readers (FIXTURES.md §C rows)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cadence.operators.checkpoint import DONE, pending_work, run_state
from cadence.operators.merge import insert_ignore, replace_by_key, upsert
from cadence.sources.landed import read_tracker_csv, split_csv_line, tracker_date

D = dt.datetime


def test_upsert_subset_and_versions(spark):
    target = spark.createDataFrame([(1, "old", "alice", 0)], "id int, title string, author string, draft int")
    batch = spark.createDataFrame(
        [(1, "t1", "bob", 1, 1), (2, "first", "carol", 0, 1), (2, "last", "dave", 1, 2)],
        "id int, title string, author string, draft int, arrival int",
    )
    out = {r["id"]: tuple(r) for r in upsert(target, batch, ["id"], "arrival", ["title", "draft"]).collect()}
    assert out[1] == (1, "t1", "alice", 1)  # author frozen
    assert out[2] == (2, "last", "carol", 1)  # frozen from first version, updatable from last


def test_upsert_idempotent(spark):
    target = spark.createDataFrame([(1, "a", None)], "id int, title string, author string")
    batch = spark.createDataFrame([(1, "b", "x", 1), (3, "c", "y", 1)], "id int, title string, author string, o int")
    once = upsert(target, batch, ["id"], "o", ["title"])
    twice = upsert(once, batch, ["id"], "o", ["title"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert {r["id"]: r["author"] for r in once.collect()}[1] is None  # stored NULL stays NULL


def test_insert_ignore_first_wins_and_null_keys(spark):
    target = spark.createDataFrame([("q", "r", None), ("q", "r", "p1")], "query string, repo string, path string")
    batch = spark.createDataFrame(
        [("q", "r", None, 1), ("q", "r", "p1", 2), ("q", "r", "p2", 3), ("q", "r", "p2", 4)],
        "query string, repo string, path string, o int",
    )
    strict = insert_ignore(target, batch, ["query", "repo", "path"], "o", nulls_collide=False)
    rows = sorted((r["path"] or "") for r in strict.collect())
    assert rows == ["", "", "p1", "p2"]  # NULL path inserted again, p1 ignored, p2 once


def test_replace_by_key_empty_batch_keeps_rows(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "repository string, v int")
    empty = spark.createDataFrame([], "repository string, v int")
    assert replace_by_key(target, empty, ["repository"]).count() == 2
    batch = spark.createDataFrame([("a", 9)], "repository string, v int")
    assert sorted(map(tuple, replace_by_key(target, batch, ["repository"]).collect())) == [("a", 9), ("b", 2)]


def test_checkpoint_pending_work(spark):
    log = spark.createDataFrame(
        [("r1", "prs:a", None, D(2024, 1, 1), "running", D(2024, 2, 1, 10)),
         ("r1", "prs:a", None, D(2024, 1, 1), DONE, D(2024, 2, 1, 11)),
         ("r2", "prs:b", None, D(2024, 1, 1), "running", D(2024, 2, 1, 10)),
         ("r2", "prs:b", None, D(2024, 1, 1), "failed", D(2024, 2, 1, 12))],
        "run_id string, entity_type string, repository_id int, since_date timestamp_ntz, status string, at timestamp_ntz",
    )
    state = {r["run_id"]: r["status"] for r in run_state(log).collect()}
    assert state == {"r1": DONE, "r2": "failed"}
    req = spark.createDataFrame(
        [("prs:a", D(2024, 1, 15)), ("prs:a", D(2024, 3, 1)), ("prs:b", D(2024, 1, 15)), ("prs:c", None)],
        "entity_type string, since_date timestamp_ntz",
    )
    left = sorted((r["entity_type"], r["since_date"]) for r in pending_work(req, log).collect())
    assert left == [("prs:a", D(2024, 3, 1)), ("prs:b", D(2024, 1, 15)), ("prs:c", None)]


def test_tracker_dates(spark):
    df = spark.createDataFrame([("3/1/24, 9:05",), ("31/2/24 9:05",), ("2024-05-06",), ("",), ("junk",)], "s string")
    got = [r[0] for r in df.select(tracker_date("s")).collect()]
    assert got == [D(2024, 1, 3, 9, 5), D(2024, 3, 2, 9, 5), D(2024, 5, 6), None, None]
    strict = [r[0] for r in df.select(tracker_date("s", strict=True)).collect()]
    assert strict[1] is None


def test_csv_split_rule(spark):
    df = spark.createDataFrame([('a, "b, c" ,,d',), ('"x""y",z',)], "line string")
    got = [r[0] for r in df.select(split_csv_line("line")).collect()]
    assert got == [["a", "b, c", "", "d"], ["xy", "z"]]


def test_read_tracker_csv(spark):
    folder = tempfile.mkdtemp(prefix="cadence-csv-")
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as f:
        f.write('ID,Data di invio,Data di scadenza,Tipologia,"Priorità",Completato,Status\n\n')
        f.write('1,"3/1/24, 9:05",2024-01-10,bug,alta,true,open\n')
        f.write("2,undefined,,feature request,,false,\n")
    rows = read_tracker_csv(spark, path).orderBy("category").collect()
    assert len(rows) == 2
    assert rows[0]["submitted_at"] == D(2024, 1, 3, 9, 5) and rows[0]["category"] == "bug"
    assert rows[1]["submitted_at"] is None and rows[1]["raw_submitted_at"] == "" and rows[1]["priority"] == ""


def test_module_scan_lenient_typing(spark):
    from cadence.sources.landed import parse_module_scan

    doc = ('{"modules": [{"source": "acme-dx/x/azurerm", "version": 3, "filePath": "main.tf", "lineNumber": 7},'
           ' "junk", {"source": 5, "lineNumber": "x"}]}')
    df = spark.createDataFrame([("org/a", doc), ("org/b", "not json")], "repo string, body string")
    rows = parse_module_scan(df, "body", "repo").orderBy("lineNumber").collect()
    assert len(rows) == 2
    assert (rows[0]["source"], rows[0]["lineNumber"]) == ("", 0.0)
    assert (rows[1]["source"], rows[1]["version"], rows[1]["filePath"], rows[1]["lineNumber"]) == \
        ("acme-dx/x/azurerm", "", "main.tf", 7.0)


def test_registry_parsers(spark):
    from cadence.sources.landed import parse_published_at, parse_registry_modules, parse_registry_versions

    page = spark.createDataFrame(
        [('{"modules": [{"name": "m", "provider": "aws", "namespace": "n"}, {"name": 1, "provider": "x", '
          '"namespace": "n"}]}',)], "body string")
    assert [tuple(r) for r in parse_registry_modules(page, "body").collect()] == [("m", "aws", "n")]
    vers = spark.createDataFrame([("m", '{"modules": [{"versions": [{"version": "1.0.0"}, {"version": 2}]}]}')],
                                 "name string, body string")
    assert [r["version"] for r in parse_registry_versions(vers, "body", ["name"]).collect()] == ["1.0.0"]
    pub = spark.createDataFrame([('{"published_at": "2024-01-02T03:04:05Z"}',), ('{"published_at": "nope"}',)],
                                "body string")
    got = [r[0] for r in pub.select(parse_published_at("body")).collect()]
    assert got[0] is not None and got[1] is None


def test_update_found_does_not_fan_out(spark):
    from cadence.operators.merge import update_found

    target = spark.createDataFrame([(1, None), (2, 5)], "id int, n int")
    details = spark.createDataFrame([(1, 7, 1), (1, 9, 2), (1, 8, 0)], "id int, n int, o int")
    assert sorted(map(tuple, update_found(target, details, ["id"], ["n"], "o").collect())) == [(1, 9), (2, 5)]
    assert sorted(map(tuple, update_found(target, details, ["id"], ["n"]).collect())) == [(1, 9), (2, 5)]


def test_malformed_base64_keeps_the_path(spark):
    from cadence.plans.ingest import import_workflows

    target = spark.createDataFrame([], "id int, repository_id int, name string, pipeline string")
    landed = spark.createDataFrame([(1, 1, "a", "uses: x\n", ".github/a.yaml", 1), (2, 1, "b", "!!!", ".github/b.yaml", 1)],
                                   "id int, repository_id int, name string, content string, path string, arrival int")
    landed = landed.withColumn("content_b64", F.when(F.col("id") == 1, F.base64(F.col("content").cast("binary"))).otherwise(F.col("content")))
    got = {r.id: r.pipeline for r in import_workflows(target, landed).collect()}
    assert got == {1: "uses: x\n", 2: ".github/b.yaml"}


def test_tracker_files_with_headers_of_their_own(spark):
    folder = tempfile.mkdtemp(prefix="cadence-csv-")
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write("\nData di invio,Tipologia\n2024-05-06,bug\n")
    with open(os.path.join(folder, "b.csv"), "w") as f:
        f.write("Tipologia,Data di invio\nfeature,2024-05-07\n")
    with open(os.path.join(folder, "c.csv"), "w") as f:
        f.write("Tipologia,Data di invio\n")
    got = sorted((r.category, r.raw_submitted_at, r.status) for r in read_tracker_csv(spark, folder).collect())
    assert got == [("bug", "2024-05-06", ""), ("feature", "2024-05-07", "")]


def test_dates_do_not_follow_the_session_zone(spark):
    from cadence.sources.landed import iso_utc

    rows = [("2025-01-01T02:00:00Z",), ("2025-01-01T02:00:00.5+02:30",), ("2025-01-01 02:00:00",), ("2025-01-01",), ("2025-01-01T02:00-0100",), ("x",)]
    df = spark.createDataFrame(rows, "s string")
    want = [D(2025, 1, 1, 2), D(2024, 12, 31, 23, 30, 0, 500000), D(2025, 1, 1, 2), D(2025, 1, 1), D(2025, 1, 1, 3), None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(iso_utc("s")).collect()] == want
            assert [r[0] for r in df.select(tracker_date("s")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_commits_of_new_repositories_create_them(spark):
    from cadence.plans.ingest import import_member_commits

    repos = spark.createDataFrame([(4, "a", "o/a", "o")], "id int, name string, full_name string, organization string")
    target = spark.createDataFrame([], "sha string, repository_id int, repository_full_name string, author string, message string")
    landed = spark.createDataFrame([("s1", "o/a", "x", "m" * 600, 1), ("s2", "p/new", "y", "m", 2), ("s2", "p/new", "z", "m", 3)],
                                   "sha string, repository_full_name string, author string, message string, arrival int")
    commits, repositories = import_member_commits(target, landed, repos)
    assert sorted((r.sha, r.repository_id, r.author, len(r.message)) for r in commits.collect()) == [("s1", 4, "x", 600), ("s2", 5, "y", 1)]
    assert (5, "new", "p/new", "p") in [tuple(r) for r in repositories.collect()]
    cut, _ = import_member_commits(target, landed, repos, message_chars=500)
    assert {len(r.message) for r in cut.collect()} == {500, 1}


def test_failed_second_attempt_does_not_undo_the_first(spark):
    from cadence.operators.checkpoint import done_already, finish_runs, start_runs

    item = spark.createDataFrame([("prs:a", None, D(2024, 1, 1))], "entity_type string, repository_id int, since_date timestamp_ntz")
    first, second = start_runs(item, D(2024, 2, 1)), start_runs(item, D(2024, 2, 2))
    log = first.union(finish_runs(first, F.lit(True), D(2024, 2, 1, 1))).union(second).union(finish_runs(second, F.lit(False), D(2024, 2, 2, 1)))
    assert done_already(item.select("entity_type", "since_date"), log).count() == 1


def test_initcap_of_any_script(spark):
    from cadence.functions.text import pg_initcap

    df = spark.createDataFrame([("priorità",), ("niñez ALTA",), ("l'ÉTÉ_à2b",), ("ßx",)], "s string")
    assert [r[0] for r in df.select(pg_initcap("s")).collect()] == ["Priorità", "Niñez Alta", "L'Été_À2b", "ßx"]


def test_stored_tables_round_trip_with_schemas(spark):
    import pytest
    from pyspark.errors import AnalysisException

    from cadence.sources.tables import Tables, read_tables, write_results, write_tables

    root = "file://" + tempfile.mkdtemp(prefix="cadence-tables-")
    repos = spark.createDataFrame([(4, "a", "o/a", "o")], "id int, name string, full_name string, organization string")
    write_tables(Tables(repositories=repos), root)
    write_results({"config": spark.createDataFrame([("k", "v")], "key string, value string")}, root)
    t = read_tables(spark, root, missing_ok=True)
    assert t.names() == ["repositories", "config"] and t.repositories.collect() == repos.collect()
    with pytest.raises(AnalysisException):
        read_tables(spark, root)


def test_as_of_of_a_folder_by_uri_is_not_stale(spark, tmp_path):
    """A folder whose files cannot be looked at from here gets a fresh anchor; a local one by URI is looked at."""
    import datetime as dt
    import shutil

    from cadence.sources import bound
    from conftest import SMALL

    for name in ("orders", "lineitem", "customer", "nation", "region"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path)
    uri = f"file://{tmp_path}"
    latest = lambda: spark.range(1).select(bound.bound_as_of(bound.bind(spark, uri)).alias("a")).first().a
    before = latest()
    late = spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 9 years"))
    late.coalesce(1).write.parquet(f"{tmp_path}/new")
    part = next((tmp_path / "new").glob("*.parquet"))
    shutil.copy(part, f"{tmp_path}/lineitem.parquet")
    assert latest() > before + dt.timedelta(days=365)
    known, bound._dir_stamp = bound._dir_stamp, lambda folder: ()  # as on another file system
    try:
        assert not bound._dir_stamp(uri) and latest() > before
        assert "scalar-subquery" in spark.range(1).select(bound.bound_as_of(bound.bind(spark, uri)))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        bound._dir_stamp = known


@pytest.mark.parametrize("name", ["created_repositories", "import_member_commits"])
def test_facts_are_not_dealt_by_the_few_repositories(spark, name):
    """A shuffle by repository would sort all line items of one nation in one task."""
    from __spark_entry__ import queries
    from conftest import SMALL

    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c_nationkey" not in plan
