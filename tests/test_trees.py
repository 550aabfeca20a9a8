"""Directory trees, summaries, table functions and numbers of runs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import extract, extract_ts, ordered, table_functions, trees
from sparkloom.sources import observed
from tests.test_extraction import BASE, SERVICE, THING, TS


def _listing(paths):
    tree = {}
    for p in paths:
        at = tree
        for x in p.replace("\\", "/").split("/"):
            at = at.setdefault(x, {})
    out = ["."]

    def show(at, pad):
        names = sorted(at)
        for x in names:
            end = x == names[-1]
            out.append(pad + ("└── " if end else "├── ") + x + ("/" if at[x] else ""))
            show(at[x], pad + ("    " if end else "│   "))

    show(tree, "")
    return out


def test_directory_trees(spark):
    rng = random.Random(3)
    files = [("a", p) for p in ("src/api/main.py", "src/api/auth.py", "src/storage/db.py", "README.md", "src/api/auth.py", "src\\win\\x.py", "one/two/three/four.py", "src-x/a.py", "Src/b.py", "é/ü.py")]
    files += [("b", "/".join(rng.choice("xyz") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 5))) + ".py") for _ in range(150)] + [("c", "only.py")]
    lines = trees.directory_tree(spark.createDataFrame(files, "repo_id string, file_path string")).collect()
    for repo in "abc":
        mine = sorted((r["n"], r["line"]) for r in lines if r["repo_id"] == repo)
        assert [n for n, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == _listing([p for k, p in files if k == repo])
    assert trees.directory_tree(spark.createDataFrame([], "repo_id string, file_path string")).collect() == []


@pytest.mark.parametrize("width", [2, 3, 1000])
def test_summaries_equal_a_fold(spark, monkeypatch, width):
    rng = random.Random(width)
    files = [(rng.choice("rs"), f"{rng.choice(['a', 'a', 'a/b', 'c'])}/f{i:03}.py" if i % 9 else f"top{i}.py", str(i)) for i in range(120)]
    df = spark.createDataFrame(files, "repo_id string, file_path string, text string")
    seen = []
    plain = ordered.running
    monkeypatch.setattr(trees, "running", lambda *a: (seen.append(a[1]), plain(*a))[1])
    join = lambda x: F.when(F.size(x) <= width, F.array_join(x, "+"))  # noqa: E731  nothing where a node is too wide
    folders, repos = trees.summaries(df, join, width, fallback=lambda x: F.raise_error(F.lit("too wide")).cast("string"))
    per = {}
    for repo, path, t in sorted(files):
        per.setdefault(repo, {}).setdefault(path.rpartition("/")[0] or ".", []).append(t)
    assert {(r["repo_id"], r["folder"], r["text"]) for r in folders.collect()} == {(k, f, "+".join(t)) for k, fs in per.items() for f, t in fs.items()}
    assert {r["repo_id"]: r["text"] for r in repos.collect()} == {k: "+".join("+".join(fs[f]) for f in sorted(fs)) for k, fs in per.items()}


def test_summaries_from_caches_and_fallback(spark):
    files = spark.createDataFrame([("r", "a/x.py", "1"), ("r", "a/y.py", "2"), ("r", "b/z.py", "3"), ("r", "top.py", "4"), ("s", "a.py", "5"), ("t", "q/a.py", None)], "repo_id string, file_path string, text string")
    join = lambda t: F.concat(F.lit("("), F.array_join(t, "+"), F.lit(")"))
    folders, repos = trees.summaries(files, join)
    assert {r["repo_id"]: r["text"] for r in repos.collect()} == {"r": "((4)+(1+2)+(3))", "s": "((5))", "t": "(())"} and folders.count() == 5
    kept = spark.createDataFrame([("r", "a", "kept"), ("r", "gone", "old"), ("s", ".", "dot")], "repo_id string, folder string, summary string")
    folders, repos = trees.summaries(files, join, 2, kept, spark.createDataFrame([("s", "whole")], "repo_id string, summary string"))
    assert {(r["repo_id"], r["text"], r["from_cache"]) for r in repos.collect()} == {("r", "(((4)+kept)+((3)))", False), ("s", "whole", True), ("t", "(())", False)}
    assert {(r["folder"], r["from_cache"]) for r in folders.filter("repo_id = 'r'").collect()} == {("a", True), ("b", False), (".", False)}
    _, repos = trees.summaries(files.filter("repo_id = 'r'"), lambda t: F.lit(None).cast("string"))
    assert repos.first()["text"] == "4\n1\n2\n3"
    with pytest.raises(ValueError, match="two"):
        trees.summaries(files, join, 1)
    ents = spark.createDataFrame([("r", "a", f"f{i % 3}.py", i, f"e{i}") for i in range(60)], "repo_id string, folder string, file_path string, start_line int, id string")
    want = [f"e{i}" for i in sorted(range(60), key=lambda i: (i % 3, i))]
    assert trees.cached_ids(ents, ["repo_id", "folder"], trees.FOLDER_IDS).first()["ids"] == want[:50] and trees.cached_ids(ents, ["repo_id"], trees.REPO_IDS).first()["ids"] == want


def test_extraction_from_sql(spark):
    files = [("r", "python/models/base.py", BASE), ("r", "python/service.py", SERVICE), ("r", "typescript/index.ts", TS), ("r", "typescript/models/thing.model.ts", THING), ("r", "web/v.tsx", "export function V() { return <a/>; }"), ("r", "README.md", "# x"), ("r", "python/none.py", None)]
    df = spark.createDataFrame(files, "repo_id string, file_path string, content string")
    df.createOrReplaceTempView("some_files")
    table_functions.register(spark)
    got = spark.sql("SELECT f.* FROM some_files s, LATERAL source_facts(s.repo_id, s.file_path, s.content) f")
    want = extract_ts.facts(df)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    per = spark.sql("SELECT f.type, count(*) AS n FROM some_files s, LATERAL python_facts(s.repo_id, s.file_path, s.content) f WHERE f.kind = 'entity' GROUP BY f.type")
    assert {tuple(r) for r in per.collect()} == {tuple(r) for r in extract.python_facts(df.filter("file_path like '%.py'")).filter("kind = 'entity'").groupBy("type").count().collect()}
    ids = df.select("file_path", *[T.module_id(F.col("file_path"), F.lit(k)).alias(k) for k in ("python", "typescript")]).collect()
    assert all(table_functions.module_of(r["file_path"], k) == r[k] for r in ids for k in ("python", "typescript"))


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [("a", "class", "x"), ("b", "method", ""), ("c", "method", None)]
    run = observed.Ingest()
    jobs = spark.sparkContext.statusTracker()
    e = run.entities(spark.createDataFrame(rows, "id string, type string, source string"), ("class", "method", "module"))
    g = run.edges(spark.createDataFrame([("a", "b", "CALLS"), ("a", None, "CALLS")], "source_id string, target_id string, type string"), ("CALLS",))
    e.write.parquet(str(tmp_path / "e"))
    g.write.parquet(str(tmp_path / "g"))
    assert run.counts() == {"entities": {"rows": 3, "class": 1, "method": 2, "module": 0, "without_source": 2}, "edges": {"rows": 2, "CALLS": 2, "external": 1}} and jobs is not None


def test_progress_of_streams(spark, tmp_path):
    heard = observed.Progress()
    spark.streams.addListener(heard)
    try:
        spark.createDataFrame([(i,) for i in range(7)], "i int").write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("i int").parquet(str(tmp_path / "in")).writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(100):
            if heard.ended and heard.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    rows = heard.table(spark).filter("query = 'counted'").collect()
    assert sum(r["rows_in"] for r in rows) == 7 and heard.ended[-1][1] is None
