"""Source files of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..schemas import KNOWN_EXTENSIONS, SUPPORTED_EXTENSIONS
from .datasource import register


def walk(spark: SparkSession, path: str, repo_id: str | None = None, depth: int = 2, repos: list[str] | None = None, languages: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(repo_id, file_path, language, content) of the supported files below a path that executors see.

    Without ``repo_id``, every folder of the path is a repository. Names and contents
    are found by tasks; the driver lists folders, ``depth`` levels down. ``repos``,
    ``languages`` and the ``prefix`` of paths prune folders and files.
    """
    register(spark)
    reader = spark.read.format("repository").option("depth", depth).option("prefix", prefix)
    reader = reader.option("repos", ",".join(repos or [])).option("languages", ",".join(languages or []))
    return (reader.option("repo_id", repo_id) if repo_id else reader).load(path)


def changes(spark: SparkSession, path: str, repo_id: str | None = None, settle_seconds: float = 1) -> DataFrame:
    """The same as a stream: files as they are made or changed."""
    register(spark)
    reader = spark.readStream.format("repository").option("settle_seconds", settle_seconds)
    return (reader.option("repo_id", repo_id) if repo_id else reader).load(path)


def scan_languages(files: DataFrame, repo_col: str, path_col: str = "path") -> DataFrame:
    """Whether a repository has supported files, and the sorted names of known languages that are not."""
    name = basename(F.col(path_col))
    ext = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    known = files.sparkSession.createDataFrame(list(KNOWN_EXTENSIONS.items()), "ext string, language string")
    df = files.select(repo_col, ext.alias("ext")).distinct().join(F.broadcast(known), "ext", "left")
    return df.groupBy(repo_col).agg(
        F.bool_or(F.col("ext").isin(*SUPPORTED_EXTENSIONS)).alias("has_supported"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("unsupported")
    )
