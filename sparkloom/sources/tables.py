"""Table readers and writers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset and Spark runs in this process, as in tests, a temporary
    folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Tables that ``cut`` has written and nobody has deleted.
_made: list[tuple[SparkSession, str]] = []


def _clear(since: int = 0, but: frozenset[str] = frozenset()) -> None:
    gone = [x for x in _made[since:] if x[1] not in but]
    _made[since:] = [x for x in _made[since:] if x[1] in but]
    for spark, path in gone:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is already gone
            pass


atexit.register(_clear)


def drop(*frames: DataFrame) -> None:
    """Deletes the tables behind what ``cut`` gave. For operators: once all that reads them is written itself."""
    paths = {f._cut_at for f in frames}
    _clear(0, frozenset(path for _, path in _made if path not in paths))


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes the tables that operators cut inside it when it ends, but for those put into its list.

    For long sessions: write the results inside the scope. Without one, tables are
    deleted when the driver's process ends; a driver that is killed leaves them, under
    names that begin with the operator's, in the shared folder.
    """
    since, kept = len(_made), []
    try:
        yield kept
    finally:
        _clear(since, frozenset(f._cut_at for f in kept))


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted as what ``cut`` writes is."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "cut", group_rows: int | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder: written once, so nothing is worked
    out twice, and read with column pruning. A lost executor costs a read of these files.

    Readers hold up to 4096 rows of a file at once, but none beyond a row group: tables of
    long rows say with ``group_rows`` how many rows that may be."""
    spark = df.sparkSession
    path = place(spark, name)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert that ignores conflicts: the first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def split_external(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose unknown target is kept as a name instead of an id."""
    known = entities.select(F.col("id").alias("target_id"), F.lit(True).alias("_k"))
    df = edges.join(known, "target_id", "left")
    return df.withColumns({"external_target_name": F.when(F.col("_k").isNull(), F.col("target_id")), "target_id": F.when(F.col("_k"), F.col("target_id"))}).drop("_k")


def overwrite_repo(df: DataFrame, path: str) -> None:
    """Idempotent write of one or more repositories: only their partitions are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def scan_repo(spark: SparkSession, path: str, repo_id: str, columns: list[str] | None = None) -> DataFrame:
    """One repository by partition pruning; only the columns asked for are read."""
    df = spark.read.parquet(path).where(F.col("repo_id") == repo_id)
    return df.select(*columns) if columns else df


def drop_repo(spark: SparkSession, paths: list[str], repo_id: str) -> None:
    """Delete a repository's partition of each table."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(f"{p}/repo_id={repo_id}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_json(df: DataFrame, path: str) -> None:
    """Entities without their sources."""
    df.drop("source", "embedding").write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_lines(lines: DataFrame, path: str, order: str = "n") -> None:
    """A report of bounded size as one text file, its lines in order."""
    lines.repartition(1).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def log_lines(rows: DataFrame, step: str, fields: list[str]) -> DataFrame:
    """Structured step lines, ``[step] key=value ...``, which ``parse_log`` reads; null fields are left out."""
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{f}="), F.regexp_replace(F.col(f).cast("string"), r"\s+", "_")) for f in fields])
    return rows.select(F.concat(F.lit(f"[{step}] "), pairs).alias("value"))


def where_any(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose column is among ``values``; no filter at all if there are none."""
    return df.where(F.col(column).isin(*values)) if values else df


def entity_source(spark: SparkSession, path: str, repo: str, entity_id: str) -> DataFrame:
    """At most one row (id, source): a point lookup that prunes partitions and columns."""
    return scan_repo(spark, path, repo, ["id", "source"]).where(F.col("id") == entity_id)


def parse_log(lines: DataFrame) -> DataFrame:
    """Structured step lines ``[step] key=value ...`` as (step, fields)."""
    step = F.regexp_extract("value", r"^\[([^\]]+)\]", 1)
    pairs = F.regexp_extract_all("value", F.lit(r"(\w+)=(\S+)"), F.lit(0))
    fields = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    return lines.select(step.alias("step"), fields.alias("fields")).filter("step <> ''")


def catalog_columns(spark: SparkSession, database: str | None = None) -> list[tuple[str, str, str]]:
    return [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
