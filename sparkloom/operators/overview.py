"""Overviews of repositories, reports and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dots

CHILD_TYPES = ("function", "class", "method", "interface")


def file_map(entities: DataFrame) -> DataFrame:
    """(file_path, source, entities): every module with its source ('' without one) and its children of four types in the order of lines."""
    e = entities.filter(F.col("type").isin(*CHILD_TYPES))
    per = e.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "name", "type", "end_line"))).alias("entities"))
    mods = entities.filter("type = 'module'").select("file_path", F.coalesce("source", F.lit("")).alias("source"))
    none = F.array().cast(dict(per.dtypes)["entities"])
    return mods.join(per, "file_path", "left").withColumn("entities", F.coalesce("entities", none))


def overview_entities(entities: DataFrame, visited: DataFrame | None) -> DataFrame:
    """What an overview's citations are checked against: the entities visited, or all where none were."""
    if visited is None or visited.isEmpty():
        return entities
    return entities.join(visited.select("id").distinct(), "id", "left_semi")


def overview_report(entities: DataFrame, files: DataFrame) -> DataFrame:
    """One definition citation for the module of each file whose summary was used."""
    mods = entities.filter("type = 'module'").join(files.select("file_path").distinct(), "file_path", "left_semi")
    raw = F.format_string("[%s:%d-%d]", "file_path", "start_line", "end_line")
    return mods.select(raw.alias("raw"), "file_path", "start_line", "end_line", F.col("id").alias("entity_id"), "name", F.lit("definition").alias("kind"))


def walk_hint(n_files: Column, n_edges: Column, entries: Column, key_files: Column) -> Column:
    """Totals of a walk in words, with the first three entry points and five key files."""
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    out = F.format_string("Repository has %d files and %d cross-file edges.", n_files, n_edges)
    out = F.concat(out, F.when(F.size(entries) > 0, F.concat(F.lit(" Top entry points: "), first(entries, 3))).otherwise(""))
    return F.concat(out, F.when(F.size(key_files) > 0, F.concat(F.lit(" Key files (by entry score): "), first(key_files, 5))).otherwise(""))


def summary_context(folders: DataFrame, names: DataFrame, keys: str = "repo_id") -> DataFrame:
    """(repo_id, context): header with counts, then folder summaries (repo_id, folder, summary, files) by path; the root has a name."""
    title = F.when(F.col("folder") == ".", "(root)").otherwise(F.col("folder"))
    part = F.concat(F.lit("=== "), title, F.lit(" ===\n"), "summary")
    per = folders.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("folder", part.alias("p")))).alias("x"), F.sum("files").alias("files"), F.count("*").alias("n"))
    head = F.concat(F.lit("Repository: "), "name", F.lit("  |  "), F.col("files").cast("string"), F.lit(" files across "), F.col("n").cast("string"), F.lit(" folders"))
    return per.join(names, keys).select(keys, F.concat(head, F.lit("\n\n"), F.array_join(F.transform("x", lambda v: v["p"]), "\n\n")).alias("context"))


def repo_totals(repos: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Repositories (repo_id, ...) with n_entities and n_edges, 0 where there are none; one aggregation each."""
    e = entities.groupBy("repo_id").agg(F.count("*").alias("n_entities"))
    r = edges.groupBy("repo_id").agg(F.count("*").alias("n_edges"))
    return repos.join(e, "repo_id", "left").join(r, "repo_id", "left").na.fill(0, ["n_entities", "n_edges"])


def busy_children(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities of which a contained child calls something."""
    calls = edges.filter("type = 'CALLS'").select(F.col("source_id").alias("target_id")).distinct()
    return entities.join(edges.filter("type = 'CONTAINS'").join(calls, "target_id", "left_semi").select(F.col("source_id").alias("id")), "id", "left_semi")


def match_rates(expected: DataFrame, actual: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per value of ``by``: how many keys are expected, found and in both, and the share found of those expected (null without any)."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, keys, "full_outer")
    hit = F.count("_e") + F.count("_a") - F.count("*")
    rate = F.round(hit / F.nullif(F.count("_e"), F.lit(0)), 6)
    return both.groupBy(by).agg(F.count("_e").alias("expected"), F.count("_a").alias("found"), hit.alias("matched"), rate.alias("rate"))


def parents_first(entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Entities in an order in which every parent comes before its children: by the dots of ids."""
    return entities.withColumn("depth", dots(F.col(id_col))).orderBy("depth", id_col)


def metric(text: Column, pattern: str, default: str = "") -> Column:
    """The first group of the first match in a report, or the default."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(default))


def markdown(rows: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(n, line): a report table in Markdown, as lines in order; ``write_lines`` puts them into one file."""
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    cells = F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in rows.columns])
    body = rows.select(F.struct(*order).alias("_o"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    first = rows.sparkSession.createDataFrame(list(enumerate(head)), "n int, line string")
    return first.select("n", "line", F.lit(None).cast(body.schema["_o"].dataType).alias("_o")).unionByName(body.select(F.lit(len(head)).alias("n"), "line", "_o")).orderBy("n", "_o").select("n", "line")
