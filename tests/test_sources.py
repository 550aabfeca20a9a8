"""Ways in and out: the repository source, tables, versions, reports."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import datasource, repository, tables, versions
from sparkloom.functions import text as T


@pytest.fixture
def tree(tmp_path):
    files = {
        "one/pkg/__init__.py": b"", "one/pkg/deep/er/still/x.py": b"x = 1\n", "one/bad.py": b"s = '\xff\xfe'\n", "one/web/a.tsx": b"<a/>", "one/web/b.ts": b"let b", "one/notes.md": b"#",
        "one/node_modules/m.py": b"no", "one/.git/h.py": b"no", "one/platform/p.py": b"no", "one/pkg/__pycache__/c.py": b"no", "two/z.py": b"z = 2\n", "two/venv/v.py": b"no",
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    return tmp_path


def test_walk(spark, tree):
    got = {(r["repo_id"], r["file_path"]): r for r in repository.walk(spark, str(tree)).collect()}
    assert set(got) == {("one", "pkg/__init__.py"), ("one", "pkg/deep/er/still/x.py"), ("one", "bad.py"), ("one", "web/a.tsx"), ("one", "web/b.ts"), ("two", "z.py")}
    assert got["one", "bad.py"]["content"] == "s = '��'\n" and got["one", "web/a.tsx"]["language"] == "typescript" and got["one", "pkg/__init__.py"]["content"] == ""
    for depth in (0, 1, 9):
        assert {r["file_path"] for r in repository.walk(spark, str(tree / "one"), "r", depth).select("file_path").collect()} == {p for k, p in got if k == "one"}
    assert repository.walk(spark, str(tree / "two" / "venv"), "r").count() == 1


def test_options_prune_folders(spark, tree):
    names = lambda **x: {r["file_path"] for r in repository.walk(spark, str(tree), **x).collect()}
    assert names(languages=["typescript"], repos=["one"]) == {"web/a.tsx", "web/b.ts"} and names(repos=["two", "none"]) == {"z.py"}
    assert names(prefix="pkg/de") == {"pkg/deep/er/still/x.py"} and names(prefix="web/b.ts") == {"web/b.ts"} and names(prefix="nowhere/") == set()
    df = repository.walk(spark, str(tree))  # one frame, several filters
    assert (df.filter("file_path = 'z.py'").count(), df.count(), df.filter("language = 'typescript'").count(), df.count()) == (1, 6, 2, 6)
    parts = datasource.RepositorySource({"path": str(tree), "repos": "one", "prefix": "web/"}).reader(None).partitions()
    assert [(p.repo_id, p.folder) for p in parts] == [("one", ""), ("one", "web")]


def test_changes_as_a_stream(spark, tree, tmp_path_factory):
    out, mark = (str(tmp_path_factory.mktemp(n)) for n in ("out", "mark"))

    def run():
        q = repository.changes(spark, str(tree), settle_seconds=0).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 6
    time.sleep(0.05)
    (tree / "two/z.py").write_text("z = 3\n")
    (tree / "two/new.py").write_text("n = 1\n")
    os.remove(tree / "one/bad.py")
    assert run() == 8 and run() == 8
    assert {r["content"] for r in spark.read.parquet(out).filter("file_path = 'z.py'").collect()} == {"z = 2\n", "z = 3\n"}


def _entities(spark, repo, *names):
    return spark.createDataFrame([(f"{repo}.{n}", n, f"def {n}(): pass", repo) for n in names], "id string, name string, source string, repo_id string")


def test_overwrite_scan_and_drop(spark, tmp_path):
    at = str(tmp_path / "entities")
    tables.overwrite_repo(_entities(spark, "a", "x", "y").unionByName(_entities(spark, "b", "z")), at)
    tables.overwrite_repo(_entities(spark, "a", "x"), at)
    tables.overwrite_repo(_entities(spark, "a", "x"), at)
    assert sorted(r["id"] for r in spark.read.parquet(at).collect()) == ["a.x", "b.z"]
    plan = tables.scan_repo(spark, at, "b", ["id", "source"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan and "ReadSchema: struct<id:string,source:string>" in plan
    assert [tuple(r) for r in tables.entity_source(spark, at, "b", "b.z").collect()] == [("b.z", "def z(): pass")] and tables.entity_source(spark, at, "a", "b.z").collect() == []
    tables.drop_repo(spark, [at], "a")
    assert [r["id"] for r in spark.read.parquet(at).collect()] == ["b.z"]


def test_json_reports_logs_and_catalog(spark, tmp_path):
    e = _entities(spark, "a", "x", "y").withColumn("embedding", F.array(F.lit(1.0)))
    tables.write_json(e, str(tmp_path / "json"))
    assert sorted(tuple(r) for r in tables.read_json(spark, str(tmp_path / "json/*.json")).select("id", "name", "repo_id").collect())[0] == ("a.x", "x", "a")
    assert "source" not in spark.read.json(str(tmp_path / "json")).columns and "embedding" not in spark.read.json(str(tmp_path / "json")).columns
    (tmp_path / "pretty.json").write_text('[\n {"id": "p",\n  "name": "q"}\n]')
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "pretty.json")).collect()] == [("p", "q")]
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(50, 0, -1)], "n int, line string").repartition(3)
    tables.write_lines(lines, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect()] == ["".join(f"line {i}\n" for i in range(1, 51))]
    logged = tables.log_lines(spark.createDataFrame([(1, "a b", None)], "n int, s string, z string"), "step", ["n", "s", "z"])
    logged.write.text(str(tmp_path / "log"))
    assert [(r["step"], [tuple(f) for f in r["fields"]]) for r in tables.parse_log(spark.read.text(str(tmp_path / "log"))).collect()] == [("step", [("n", "1"), ("s", "a_b")])]
    e.createOrReplaceTempView("some_entities")
    assert ("some_entities", "name", "string") in tables.catalog_columns(spark)
    assert [r[0] for r in spark.createDataFrame([("c" * 3000, "p", None), ("", "p", None), ("", "p", "reasoning")], "a string, b string, c string").select(T.task_type(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["standard", "fast", "reasoning"]


def test_tables_of_a_repository_are_replaced_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root, "entities")
    one = versions.publish(spark, root, "a/b", {"entities": _entities(spark, "a", "x"), "edges": _entities(spark, "a", "e")})
    versions.publish(spark, root, "c", {"entities": _entities(spark, "c", "z"), "edges": _entities(spark, "c", "e")})

    class Stops(Exception):
        pass

    def stop(*a):
        raise Stops

    with monkeypatch.context() as m:  # all tables are written, the pointer is not swapped
        m.setattr(versions, "_swap", stop)
        with pytest.raises(Stops):
            versions.publish(spark, root, "a/b", {"entities": _entities(spark, "a", "x", "y"), "edges": _entities(spark, "a", "f")})
    broken = _entities(spark, "a", "f").withColumn("id", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):  # the second table fails
        versions.publish(spark, root, "a/b", {"entities": _entities(spark, "a", "x", "y"), "edges": broken})
    assert [r["id"] for r in versions.current(spark, root, "entities", "a/b").collect()] == ["a.x"]
    held = versions.current(spark, root, "entities", "a/b")  # a reader that began before the swap
    two = versions.publish(spark, root, "a/b", {"entities": _entities(spark, "a", "x", "y"), "edges": _entities(spark, "a", "f")})
    assert one != two and held.count() == 1
    assert sorted(r["id"] for r in versions.current(spark, root, "entities").collect()) == ["a.x", "a.y", "c.z"] and [r["id"] for r in versions.current(spark, root, "edges", "a/b").collect()] == ["a.f"]
    assert versions.sweep(spark, root) >= 4 and sorted(r["id"] for r in versions.current(spark, root, "edges").collect()) == ["a.f", "c.e"]
    versions.withdraw(spark, root, "c")
    assert sorted(r["id"] for r in versions.current(spark, root, "entities").collect()) == ["a.x", "a.y"]
