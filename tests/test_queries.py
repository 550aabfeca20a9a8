"""Every query of the engine against its SQL, and units with literal rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectors
from sparkloom.operators import citations, graph, memory, retrieval
from sparkloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [f[: -len(".parquet")] for f in os.listdir(SF) if f.endswith(".parquet")] if os.path.isdir(SF) else []


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _sorted(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    number = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return sorted([tuple(number(r[i]) for i in at) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(want.fetchall(), want.columns)


EDGES = [(1, "a", "b", "CALLS"), (2, "b", "c", "CALLS"), (3, "c", "a", "CALLS"), (4, "c", "c", "CALLS"), (5, "a", "d", "INHERITS"), (6, "d", "e", "IMPLEMENTS"), (7, "e", "f", "IMPLEMENTS"), (8, "a", "b", "CALLS"), (9, "x", "a", "CALLS")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "id long, source_id string, target_id string, type string")


def test_bfs_with_cycles_and_seen(spark, edges):
    roots = spark.createDataFrame([("a",)], "id string")
    got = {(r["id"], r["depth"], r["via"]) for r in graph.bfs(roots, edges, 5, ["CALLS"]).collect()}
    assert got == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b")}
    seen = spark.createDataFrame([("a", "b")], "root string, id string")
    assert {r["id"] for r in graph.bfs(roots, edges, 5, ["CALLS"], seen).collect()} == {"a"}


def test_expand_shares_one_seen_set(spark, edges):
    core = spark.createDataFrame([("a", 1)], "id string, rank int")
    ents = spark.createDataFrame([(i, "method", "m", f"{i}.py") for i in "abcdefx"], "id string, type string, parent_id string, file_path string")
    got = {(r["id"], r["role"], r["depth"]) for r in graph.expand(core, ents, edges).collect()}
    assert got == {("b", "callee", 1), ("c", "callee", 2), ("x", "caller", 1), ("d", "base", 1), ("e", "base", 2)}


def test_a_method_that_refers_to_itself_brings_its_parent(spark):
    ents = [("K", "class", None, ""), ("a", "method", "K", "return self.x + self.y(1)"), ("b", "method", "L", "self.x; myself.y"), ("L", "class", None, ""), ("f", "function", "M", "self.x self.y"), ("M", "module", None, ""), ("N", "class", None, ""), ("n", "method", "N", None), ("P", "class", None, ""), ("p", "method", "P", "self.a self.b")]
    e = spark.createDataFrame([(i, t, p, s, "f.py") for i, t, p, s in ents], "id string, type string, parent_id string, source string, file_path string")
    contains = spark.createDataFrame([(i, p, c, "CONTAINS") for i, (c, _, p, _) in enumerate(ents) if p and p != "P"], "id int, source_id string, target_id string, type string")
    core = spark.createDataFrame([(i,) for i in "abfnp"], "id string")
    assert {(r["root"], r["id"]) for r in graph.expand(core, e, contains).filter("role = 'parent'").collect()} == {("a", "K")}
    assert graph.expand(core, e.drop("source"), contains).filter("role = 'parent'").collect() == []
    both = spark.createDataFrame([("a",), ("K",)], "id string")  # a parent that is in the core itself
    assert graph.expand(both, e, contains).filter("role = 'parent'").collect() == []


def test_shortest_path(spark, edges):
    r = graph.shortest_path(edges, "x", "e").first()
    assert r["hops"] == 3 and r["path"] == ["x", "a", "d", "e"]
    assert graph.shortest_path(edges, "x", "nowhere").collect() == []


def test_budget_cuts_at_the_first_overflow(spark):
    rows = [(1, 1, 40), (1, 2, 50), (1, 3, 1), (2, 1, 400)]
    out = retrieval.within_budget(spark.createDataFrame(rows, "g int, seq int, chars int"), ["g"], ["seq"], "chars", 0, 20)
    assert [(r["g"], r["seq"]) for r in out.collect()] == [(1, 1)]


def test_classify_branches(spark, edges):
    ents = spark.createDataFrame(
        [("m.a", "a", "function", None, "f.py", 1, 9), ("m.b", "b", "function", None, "f.py", 10, 19), ("m.b.v", "v", "variable", "m.b", "f.py", 12, 12), ("m.K", "K", "class", None, "f.py", 30, 50)],
        "id string, name string, type string, parent_id string, file_path string, start_line int, end_line int",
    )
    rel = spark.createDataFrame([(1, "m.a", "m.b", "CALLS"), (2, "m.K", "m.a", "INHERITS")], "id long, source_id string, target_id string, type string")
    text = "uses [nofile.py:1-2] and plain [f.py:90-99], `b` at [f.py:10-11], a calls [f.py:14-15]; a sets [f.py:12-12]; K from [f.py:2-3]; K of [f.py:16]."
    answers = spark.createDataFrame([(1, text)], "answer_id long, answer string")
    got = {r["raw"]: (r["kind"], r["entity_id"]) for r in citations.classify(citations.parse(answers), ents, rel).collect()}
    assert got["[nofile.py:1-2]"][0] == "unsupported" and got["[f.py:90-99]"][0] == "unsupported"
    assert got["[f.py:10-11]"] == ("definition", "m.b") and got["[f.py:14-15]"] == ("call_site", "m.b")
    assert got["[f.py:12-12]"] == ("call_site", "m.b.v") and got["[f.py:2-3]"] == ("definition", "m.a") and got["[f.py:16]"] == ("unsupported", "m.b")


def test_correct_and_normalise(spark):
    a = spark.createDataFrame([(1, "see [x.py:1] twice [x.py:1]"), (2, "none")], "answer_id long, answer string")
    fix = spark.createDataFrame([(1, "[x.py:1]", "[y.py:2-3]")], "answer_id long, bad string, good string")
    assert {r["answer"] for r in citations.correct(a, fix).collect()} == {"see [y.py:2-3] twice [y.py:2-3]", "none"}
    t = spark.createDataFrame([("at [`a/b.py:1-2`] or [c.py:start-9] **Paragraph 2 — **x",)], "s string")
    c = F.col("s")
    assert t.select(T.strip_leaked_labels(T.sanitize_citations(T.normalise_citations(c)))).first()[0] == "at [a/b.py:1-2] or  x"


def test_strings(spark):
    rows = [(" HTTP://GitHub.com/Acme/My-Project.git",), ("https://gitlab.com//a///b/",), ("/home/u/p/",)]
    out = [tuple(r) for r in spark.createDataFrame(rows, "s string").select(T.canonical_source(F.col("s")), T.repo_name(F.col("s"))).collect()]
    assert out == [("https://github.com/acme/my-project", "my-project"), ("https://gitlab.com/a/b", "b"), ("/home/u/p", "p")]
    doc = spark.createDataFrame([('def f():\n    """ Says. """',), ("/**\n * One\n * two\n */\nclass A {}",), ("x = 1",)], "s string")
    assert [r[0] for r in doc.select(T.docstring(F.col("s"))).collect()] == ["Says.", "One\ntwo", ""]
    assert spark.range(1).select(vectors.cosine(vectors.literal([0, 0]), vectors.literal([1, 2]))).first()[0] is None


def test_stale_latest_hides_older_fresh(spark):
    e = spark.createDataFrame([(1, "r", "k", True, 5, 9), (2, "r", "k", True, 6, 2), (3, "r", "j", False, 7, 9), (4, "r", "n", True, 7, None)], "id int, repo_id string, k string, complete boolean, created_at int, repo_indexed_at int")
    repos = spark.createDataFrame([("r", 4)], "repo_id string, indexed_at int")
    assert memory.cache_lookup(e, repos, ["repo_id", "k"]).collect() == []


def test_token_batches_fold(spark):
    rows = [("g", i, "x" * n) for i, n in enumerate([40, 40, 400, 8, 80])]
    out = retrieval.token_batches(spark.createDataFrame(rows, "g string, i int, t string"), ["g"], ["i"], "t", 25).orderBy("i").collect()
    assert [r["batch"] for r in out] == [0, 0, 1, 2, 2]
    chunks = spark.createDataFrame([("aa\nbb\ncccc\ndddddddd\ne",)], "t string").select(retrieval.line_chunks(F.col("t"), 5)).first()[0]
    assert chunks == ["aa\nbb", "cccc", "dddddddd", "e"]


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
