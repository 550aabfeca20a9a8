"""The vector index against an exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import retrieval, vector_index
from sparkloom.sources.tables import place


def _rows(spark, n, groups, spread, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))  # one group holds a third of all rows
    v = centres[at] + spread * rng.normal(size=(n, dim))
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")


def _best(v, q, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u[q], 9)
    s[q] = -9
    return np.lexsort((np.arange(len(v)), -s))[:k].tolist()


@pytest.mark.parametrize(("n", "probes", "most_read"), [(1500, 4, 0.3), (6000, 10, 0.3)])
def test_recall_and_share_read(spark, n, probes, most_read):
    v, rows = _rows(spark, n, 60, 0.35)
    index = vector_index.build(rows, place(spark, "index"))
    asked, want = rows.filter("id % 50 = 0"), {q: _best(v, q, 10) for q in range(0, n, 50)}
    read = []
    got = vector_index.search(spark, index, asked, 10, probes, others=True, read=read).groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()
    assert np.mean([len({*r["ids"]} & {*want[r["query_id"]]}) / 10 for r in got]) >= 0.95 and read[0] < most_read
    read = []
    exact = vector_index.search(spark, vector_index.load(spark, index.path), asked, 10, others=True, read=read).orderBy("query_id", "rank").collect()
    found = {}
    for r in exact:
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == want and sum(read) < 1


def test_search_reads_the_folders_it_probes(spark):
    v, rows = _rows(spark, 1000, 20, 0.3)
    index = vector_index.build(rows, place(spark, "index"), cells=20)
    plan = vector_index.search(spark, index, rows.filter("id = 7"), 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and index.count.sum() == 1000


def test_one_query_equals_the_scan(spark):
    v, rows = _rows(spark, 400, 7, 0.5)
    index = vector_index.build(rows, place(spark, "index"))
    want = [r["id"] for r in retrieval.search(rows, v[3].tolist(), 6).collect()]
    asked = spark.createDataFrame([("a", v[3].tolist())], "name string, v array<double>")
    assert [r["id"] for r in vector_index.search(spark, index, asked, 6, None, "name", "v").orderBy("rank").collect()] == want
    assert [r["id"] for r in vector_index.search(spark, index, asked, 6, len(index.count), "name", "v").orderBy("rank").collect()] == want


def test_odd_vectors(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, None]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.build(df, place(spark, "index"))
    assert index.count.sum() == 5
    monkeypatch.setattr(vector_index, "MAX_QUERIES", 2)  # queries in blocks
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector_index.search(spark, index, df, 9, others=True).collect()}
    assert {q for q, _ in got} == {1, 2, 7, None, 10}
    assert [got[1, r] for r in (1, 2, 3, 4)] == [2, None, 7, 10] and got[7, 1] is None
    none = vector_index.build(df.limit(0), place(spark, "index"))
    assert vector_index.search(spark, none, df).collect() == [] and vector_index.search(spark, index, df.limit(0)).collect() == []
