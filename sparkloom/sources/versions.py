"""All tables of a repository replaced at once.

A version is a folder of its own; which one holds is told by a pointer file, which is
swapped last, in one rename. Who reads meanwhile sees the old tables or the new ones,
never some of each, and a writer that stops half-way has changed nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """(repo_id, version), a row per repository."""
    at, fs = _fs(spark, f"{root}/_current")
    if not fs.exists(at) or not any(f.getPath().getName().endswith(".json") for f in fs.listStatus(at)):
        return None
    return spark.read.schema("repo_id string, version string").option("pathGlobFilter", "*.json").json(f"{root}/_current/")


def _name(repo_id: str) -> str:
    """A file name for a repository's id, whatever characters it has."""
    return repo_id.encode().hex()


def _swap(spark: SparkSession, root: str, repo_id: str, version: str) -> None:
    jvm = spark.sparkContext._jvm
    made, fs = _fs(spark, f"{root}/_current/.{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps({"repo_id": repo_id, "version": version}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    to, _ = _fs(spark, f"{root}/_current/{_name(repo_id)}.json")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(made), context.makeQualified(to), options)


def publish(spark: SparkSession, root: str, repo_id: str, tables: dict[str, DataFrame]) -> str:
    """Replace all tables of a repository by ``tables``; returns the new version.

    Tables are written one after another to a folder that nobody reads, then the pointer
    is swapped, and what it pointed at before is deleted by ``sweep`` when nobody reads
    it any more.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumn("repo_id", F.lit(repo_id)).write.parquet(f"{root}/{name}/v={version}")
    _swap(spark, root, repo_id, version)
    return version


def current(spark: SparkSession, root: str, name: str, repo_id: str | None = None) -> DataFrame:
    """A table of one repository, or of all, as the pointers are now."""
    pointers = _pointers(spark, root)
    rows = [] if pointers is None else pointers.filter(F.lit(True) if repo_id is None else F.col("repo_id") == repo_id).collect()  # a row a repository
    if not rows:
        raise FileNotFoundError(f"{root} holds no version" + (f" of {repo_id}" if repo_id else ""))
    return spark.read.parquet(*[f"{root}/{name}/v={r['version']}" for r in rows])


def withdraw(spark: SparkSession, root: str, repo_id: str) -> None:
    """Take a repository out: all of its tables are gone at once."""
    at, fs = _fs(spark, f"{root}/_current/{_name(repo_id)}.json")
    fs.delete(at, False)


def sweep(spark: SparkSession, root: str) -> int:
    """Delete the versions that no pointer names; returns how many folders went. To be run when no one writes."""
    pointers = _pointers(spark, root)
    kept = set() if pointers is None else {r["version"] for r in pointers.collect()}
    at, fs = _fs(spark, root)
    gone = 0
    for table in fs.listStatus(at):
        if table.getPath().getName().startswith("_"):
            continue
        for v in fs.listStatus(table.getPath()):
            if v.getPath().getName().removeprefix("v=") not in kept:
                fs.delete(v.getPath(), True)
                gone += 1
    return gone
