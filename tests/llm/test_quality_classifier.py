import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import quality_classifier as Q

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def result(spark):
    return Q.op4_bayes_quality_classifier(spark, D).toPandas()


def test_held_out_labels(spark):
    """Fitted on labels of ids that are not multiples of 3, tested on the rest."""
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    out = Q.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = out.selectExpr("avg(if(quality = 1, int(kept), null)) as good", "avg(if(quality = 0, int(kept), null)) as bad").first()
    assert r.good > 0.98 and r.bad < 0.1


def test_posteriors_by_brute_force(spark, result):
    """Site posteriors and scores recomputed row by row from the evidence."""
    df = result
    assert len(df) == spark.read.parquet(f"{D}/documents.parquet").count()
    p = 1 / (1 + np.exp(-df.evidence))
    mean = p.mean()

    def strength(keys, parent):
        g = [p[idx].to_numpy() for _, idx in df.groupby(keys).groups.items()]
        par = [parent[idx].iloc[0] for _, idx in df.groupby(keys).groups.items()]
        pairs = [(x, m) for x, m in zip(g, par) if len(x) >= 2]
        inside = np.mean([max(1e-6, np.mean(x * x) - x.mean() ** 2) for x, _ in pairs])
        between = sum(len(x) * (x.mean() - m) ** 2 for x, m in pairs)
        spread = max(0.0, (between - len(pairs) * inside) / sum(len(x) for x, _ in pairs))
        return min(Q.STRENGTH[1], max(Q.STRENGTH[0], inside / spread if spread > 0 else Q.STRENGTH[1]))

    hk = strength(["host"], p * 0 + mean)
    host_mean = p.groupby(df.host).transform("mean")
    pk = strength(["host", "path"], host_mean)
    host_n, host_p = p.groupby(df.host).transform("size"), p.groupby(df.host).transform("sum")
    key = df.host + "\0" + df.path
    path_n, path_p = p.groupby(key).transform("size"), p.groupby(key).transform("sum")
    host = (host_p - p + hk * mean) / (host_n - 1 + hk)
    path = (path_p - p + pk * host) / (path_n - 1 + pk)
    clip = lambda x: np.clip(x, 1e-4, 1 - 1e-4)
    logit = lambda x: np.log(clip(x) / (1 - clip(x)))
    odds = df.evidence + Q.SITE_WEIGHT * (logit(path) - logit(mean))
    assert np.allclose(df.host_posterior, host) and np.allclose(df.path_posterior, path)
    assert np.allclose(df.score, 1 / (1 + np.exp(-odds))) and (df.kept == (odds >= 0)).all()


def test_sparse_site_shrinks_to_its_parent(spark, docs_of):
    good, bad = "the cat sat on a mat and looked at that dog over there ", "BUY!! NOW!! "
    rows = [(i, good * 3 + f"number {i}", "en", "g") for i in range(60)] + [(100 + i, bad * 20 + str(i), "en", "b") for i in range(60)]
    rows += [(200, good * 2, "en", "lonely"), (201, good * 2, None, None), (202, None, "en", "g"), (203, "", "en", "g")]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(999, 1), (5, None)],
                                   "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.classify(docs_of(rows), labels).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept for i in range(60)) and not any(out[100 + i].kept for i in range(60))
    assert out[0].host_posterior > out[200].host_posterior > out[100].host_posterior
    assert out[201].host == "" and out[200].kept


def test_edges(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(docs_of([]), labels).count() == 0
    df = docs_of([(1, "a b"), (1, "a b"), (2, None)]).selectExpr("*", "1 as host", "2 as p", "3 as good", "4 as path")
    out = Q.classify(df, labels, host=F.col("source"), path=F.col("lang")).collect()
    assert len(out) == 3 and all(r.kept and math.isclose(r.evidence, 0) for r in out)


def test_site_of_url(spark):
    df = spark.createDataFrame([("https://A.example/x/y?z",), ("http://b.example",), ("not a url",), (None,)], "u string")
    host, path = Q.site_of_url(F.col("u"))
    assert [tuple(r) for r in df.select(host, path).collect()][0] == ("a.example", "a.example/x")
