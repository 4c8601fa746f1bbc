import duckdb
import pytest

from cadence.llm.registry import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from (doc_id, text[, lang, source]) rows."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return build


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def compare(spark):
    """Rows of a query and of its SQL at sf0.001, sorted, with columns by name."""
    def run(name):
        df = queries()[name](spark, SMALL)
        cols = sorted(df.columns)
        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "conversations"):
            con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
        rel = con.sql(oracle_sql()[name])
        assert cols == sorted(rel.columns)
        got = sorted(tuple(r) for r in df.select(*cols).collect())
        want = sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall())
        return got, want
    return run
