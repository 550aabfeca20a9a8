"""Trees over the paths of a repository: a directory listing as text, and summaries from files up to the repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folder
from ..sources.tables import cut
from .ordered import running

# How branches are drawn, and how many ids a cached summary names.
LAST, INNER, BLANK, BAR = "└── ", "├── ", "    ", "│   "
FOLDER_IDS, REPO_IDS = 50, 500


def directory_tree(files: DataFrame, repo_col: str = "repo_id", path_col: str = "file_path") -> DataFrame:
    """(repo, n, line): the lines of each repository's directory tree, numbered from 0; line 0 is the root.

    Entries of a folder are in the order of their names, folders end in a slash. Whether
    an entry is the last of its folder is found once and carried down to all below it by
    a join, so no repository meets in one row or task. Paths that repeat are one.
    """
    parts = F.split(F.regexp_replace(path_col, r"\\", "/"), "/")
    keys = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.slice("_p", F.lit(1), i))
    rows = files.select(F.col(repo_col).alias("repo"), parts.alias("_p")).distinct()
    rows = rows.select("repo", F.explode(keys).alias("key"), F.size("_p").alias("_n")).groupBy("repo", "key").agg(F.max("_n").alias("_n"))
    rows = rows.select("repo", "key", F.slice("key", F.lit(1), F.size("key") - 1).alias("up"), F.element_at("key", -1).alias("name"), (F.col("_n") > F.size("key")).alias("open"))
    last = rows.groupBy("repo", "up").agg(F.max("name").alias("_last"))
    rows = cut(rows.join(last, ["repo", "up"]).withColumn("last", F.col("name") == F.col("_last")).drop("_last"), "tree")
    # Every entry with the folders above it, each a row.
    above = rows.filter("size(key) > 1").select("repo", "key", F.explode(F.transform(F.sequence(F.lit(1), F.size("key") - 1), lambda i: F.slice("key", F.lit(1), i))).alias("above"))
    bars = above.join(rows.select("repo", F.col("key").alias("above"), F.col("last").alias("_l")), ["repo", "above"])
    bars = bars.groupBy("repo", "key").agg(F.array_sort(F.collect_list(F.struct(F.size("above").alias("d"), "_l"))).alias("_b"))
    indent = F.array_join(F.transform(F.coalesce("_b", F.array()), lambda b: F.when(b["_l"], BLANK).otherwise(BAR)), "")
    line = F.concat(indent, F.when(F.col("last"), LAST).otherwise(INNER), "name", F.when(F.col("open"), "/").otherwise(""))
    lines = rows.join(bars, ["repo", "key"], "left").select("repo", "key", line.alias("line"))
    roots = files.select(F.col(repo_col).alias("repo")).distinct().select("repo", F.array().cast("array<string>").alias("key"), F.lit(".").alias("line"))
    out = running(roots.unionByName(lines), ["repo"], ["key"], {})
    return out.select(F.col("repo").alias(repo_col), F.col("pos").alias("n"), "line")


def reduced(rows: DataFrame, keys: list[str], order: str, text_col: str, summarise: Callable[[Column], Column], width: int, fallback: Callable[[Column], Column]) -> DataFrame:
    """(keys, text): one text for each group, by a tree in which no node has more than ``width`` texts below it.

    ``summarise`` turns an array of texts, in order, into one; where it gives nothing,
    ``fallback`` does. A group of one text is summarised too; levels above the first
    only where there is more than one.
    """
    if width < 2:
        raise ValueError("a node has at least two texts")
    level = rows.select(*keys, F.col(order).alias("_k"), F.col(text_col).alias("_t"))
    first = True
    while True:
        placed = running(level, keys, ["_k"], {})
        placed = cut(placed.withColumn("_node", F.floor(F.col("pos") / width)), "tree_level")
        most = placed.agg(F.max("_node").alias("m")).first()["m"]
        if most is None:
            return placed.select(*keys, F.col("_t").alias("text"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"])
        nodes = placed.groupBy(*keys, "_node").agg(texts.alias("_x"))
        made = F.coalesce(F.nullif(summarise(F.col("_x")), F.lit("")), fallback(F.col("_x")))
        text = made if first else F.when(F.size("_x") > 1, made).otherwise(F.get("_x", 0))
        level = nodes.select(*keys, F.col("_node").alias("_k"), text.alias("_t"))
        if most == 0:
            return level.select(*keys, F.col("_t").alias("text"))
        first = False


def summaries(
    files: DataFrame, summarise: Callable[[Column], Column], width: int = 100, cached_folders: DataFrame | None = None, cached_repos: DataFrame | None = None,
    fallback: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(folders, repositories): (repo_id, folder, text, from_cache) and (repo_id, text, from_cache) of (repo_id, file_path, text).

    A repository in ``cached_repos`` (repo_id, summary) is not read at all, a folder in
    ``cached_folders`` (repo_id, folder, summary) is not read below. ``fallback`` is used
    where ``summarise`` gives null or nothing; texts are then joined by lines.
    """
    fallback = fallback or (lambda texts: F.array_join(texts, "\n"))
    df = files.withColumn("folder", folder(F.col("file_path")))
    known = None if cached_repos is None else cached_repos.select("repo_id", F.col("summary").alias("text"))
    if known is not None:
        df = df.join(known.select("repo_id"), "repo_id", "left_anti")
    todo, had = df, None
    if cached_folders is not None:
        mine = df.select("repo_id", "folder").distinct()
        had = cached_folders.join(mine, ["repo_id", "folder"], "left_semi").select("repo_id", "folder", F.col("summary").alias("text"), F.lit(True).alias("from_cache"))
        todo = df.join(cached_folders.select("repo_id", "folder"), ["repo_id", "folder"], "left_anti")
    folders = reduced(todo, ["repo_id", "folder"], "file_path", "text", summarise, width, fallback).withColumn("from_cache", F.lit(False))
    folders = cut(folders if had is None else folders.unionByName(had), "folder_summaries")
    repos = reduced(folders, ["repo_id"], "folder", "text", summarise, width, fallback).withColumn("from_cache", F.lit(False))
    return folders, repos if known is None else repos.unionByName(known.withColumn("from_cache", F.lit(True)))


def cached_ids(entities: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, ids): the ids of the first ``most`` entities of each group, by file and line, for a cached summary to name."""
    some = running(entities.select(*keys, "file_path", "start_line", "id"), keys, ["file_path", "start_line", "id"], {}).filter(F.col("pos") < most)
    return some.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
