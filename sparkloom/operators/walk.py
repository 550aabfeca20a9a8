"""Views of the file graph, walks, searches that go on, and plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import graph, retrieval


def file_nodes(entities: DataFrame, entries: DataFrame) -> DataFrame:
    """One node per file: children, whether it is an entry point, its score and whether it is the root (the first entry)."""
    per = entities.groupBy("file_path").agg(F.count_if(F.col("type") != "module").alias("children"), F.min(F.when(F.col("type") == "module", F.col("id"))).alias("id"))
    first = entries.agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("root"))
    df = per.join(entries.select("id", "score"), "id", "left").crossJoin(F.broadcast(first))  # one row
    return df.select("id", "file_path", "children", F.col("score").isNotNull().alias("is_entry"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce(F.col("id") == F.col("root"), F.lit(False)).alias("is_root"))


def file_links(file_edges: DataFrame) -> DataFrame:
    """File edges as (id, source_id, target_id, type) with the dominant type, for traversals."""
    return file_edges.select(F.xxhash64("source_file", "target_file").alias("id"), F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"), F.col("dominant").alias("type"))


def graph_view(nodes: DataFrame, links: DataFrame, root: str | None, depth: int = 3, show_all: bool = False, orphans: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, links): the whole graph at depth 0, or what the root reaches within 1 to 10 hops."""
    files = nodes.withColumnRenamed("file_path", "fid")
    if show_all or root is None:
        # Without a root every entry point is one.
        seen = files.withColumns({"depth": F.lit(0), "is_root": F.col("is_entry")})
        if not orphans:
            lone = graph.orphans(files.select(F.col("fid").alias("id")), links).select(F.col("id").alias("fid"))
            seen = seen.join(lone, "fid", "left_anti")
    else:
        start = files.filter(F.col("fid") == root).select(F.col("fid").alias("id"))
        reached = graph.bfs(start, links, max(1, min(10, depth))).select(F.col("id").alias("fid"), "depth")
        seen = files.join(reached, "fid")
    kept = graph.induced(seen.select(F.col("fid").alias("id")), links)
    return seen.withColumnRenamed("fid", "file_path").orderBy("depth", "file_path"), kept


def with_entities(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with their entities in the order of lines."""
    e = entities.filter(F.col("type").isin("class", "interface", "function", "method", "variable"))
    per = e.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "name", "type", "end_line"))).alias("entities"))
    return nodes.join(per, "file_path", "left")


def expand_file(path: str, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave or enter a file, each (source, target, type) once; one join, not one query per edge."""
    at = entities.select("id", "file_path")
    both = edges.join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("_s")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("_t")), "target_id")
    both = both.filter("_s <> _t").filter((F.col("_s") == path) | (F.col("_t") == path))
    way = F.when(F.col("_s") == path, "out").otherwise("in")
    return both.groupBy("source_id", "target_id", "type").agg(F.min("id").alias("id"), F.min(way).alias("direction"))


def repo_walk(nodes: DataFrame, links: DataFrame, entities: DataFrame, root: str | None, files: int = 10, per_walk: int = 30) -> DataFrame:
    """Modules of the best files that a walk of depth 3 reaches, then their entities, with scores by rank."""
    seen, _ = graph_view(nodes, links, root, 3, root is None)
    best = seen.orderBy(F.desc("score"), F.desc("is_entry"), F.desc("is_root"), "file_path").limit(files).select("file_path", "is_entry")
    e = entities.join(F.broadcast(best), "file_path")
    mods = e.filter("type = 'module'").withColumn("base", F.when(F.col("is_entry"), 1.0).otherwise(0.8))
    rest = e.filter("type <> 'module'").orderBy("file_path", "start_line", "id").limit(per_walk).withColumn("base", F.lit(0.6))
    found = mods.unionByName(rest).dropDuplicates(["id"])
    rank = F.row_number().over(W.orderBy(F.desc("base"), "file_path", "start_line", "id"))  # at most files + per_walk rows
    found = found.withColumn("rank", rank)
    return found.select("id", "file_path", "type", "rank", retrieval.synthetic_score(F.col("base"), F.col("rank")).alias("score"))


def initial_visible(nodes: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Root, its neighbours and files without edges."""
    ids = nodes.select(F.col("file_path").alias("id"))
    near = graph.neighbours(ids.filter(F.col("id") == root), links).select(F.col("neighbour").alias("id"))
    return ids.filter(F.col("id") == root).unionByName(near).unionByName(graph.orphans(ids, links)).distinct()


def visible(nodes: DataFrame, links: DataFrame, root: str, expanded: DataFrame) -> DataFrame:
    """What shows when the nodes of ``expanded`` (id) are open; collapsing is leaving them out."""
    more = graph.neighbours(expanded, links).select(F.col("neighbour").alias("id"))
    return initial_visible(nodes, links, root).unionByName(expanded.select("id")).unionByName(more).distinct()


def highlight(links: DataFrame, start: str, end: str) -> DataFrame:
    """Nodes of the shortest path and their neighbours; the end and its neighbours where there is none."""
    path = graph.shortest_path(links, start, end).select(F.explode("path").alias("id"))
    if path.isEmpty():
        path = links.sparkSession.createDataFrame([(end,)], "id string")
    return path.unionByName(graph.neighbours(path, links).select(F.col("neighbour").alias("id"))).distinct()


def targeted_query(status: Column, rewrite: Column, missing: Column, goal: Column) -> Column:
    """What the next search asks for: the rewritten query, else the entity that was missing, else the goal."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(status == "rewrite_search", some(rewrite)), F.when(status == "insufficient", some(missing)), goal)


def targeted(entities: DataFrame, edges: DataFrame, query: Sequence[float] | None, visited: DataFrame, k: int = 5, expand: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new core entities, their expansion, visited with them): search again, without what was visited.

    Without a query vector (its embedding failed) there is nothing new. Where everything
    found was visited, nothing is expanded. If the expansion fails, the core entities
    stand without one. ``expand`` is ``graph.expand`` unless the caller brings another.
    """
    schema = graph.expand(visited.limit(0).select("id"), entities.drop("embedding"), edges).schema if expand is None else None
    empty = visited.sparkSession.createDataFrame([], schema or "root string, id string, role string, depth int, via string")
    if query is None:
        return entities.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0), empty, visited
    core = retrieval.unseen(retrieval.search(entities, query, k).select("id", "score"), visited)
    core = cut(retrieval.ranked(core, [F.desc("score"), F.col("id")]), "targeted")
    seen = visited.select("id").unionByName(core.select("id"))
    if core.isEmpty():
        return core, empty, seen
    try:
        more = cut((expand or graph.expand)(core, entities.drop("embedding"), edges), "targeted_expansion")
    except PySparkException:
        more = empty
    return core, more, seen


def traces(expanded: DataFrame, entities: DataFrame) -> DataFrame:
    """(root, trace): calls of depth one and two, a line each, in the order of ids."""
    e = entities.select("id", "name", "file_path", "start_line")
    rows = expanded.filter("role = 'callee' and depth <= 2").join(e, "id").join(e.select(F.col("id").alias("via"), F.col("name").alias("by")), "via")
    pad = F.when(F.col("depth") == 1, "  -> ").otherwise("    -> ")
    line = F.concat(pad, "by", F.lit(" calls "), "name", F.format_string(" [%s:%d]", "file_path", "start_line"))
    per = rows.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("depth", "id", line.alias("l")))).alias("x"))
    return per.select("root", F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("trace"))


def between(text: Column, first: str, second: str) -> Column:
    """What stands between two markers; to the end without the second; empty without the first."""
    after = F.substring(text, F.instr(text, first) + len(first), F.length(text))
    return F.when(F.instr(text, first) == 0, "").otherwise(F.substring_index(after, second, 1))


# Intents and strategies of plans.
INTENTS = ("feature", "dependency_flow", "repository_overview", "repository_detailed", "specific_lookup", "query")
STRATEGIES = ("semantic_search", "semantic_search_with_graph", "repository_walk")


def parse_plan(df: DataFrame, raw: str, question: str) -> DataFrame:
    """Planner output to (intent, retrieval_strategy, search_query, confidence).

    Without a JSON object: a plain search for the question, confidence 0. Unknown
    values fall back; a walk has no query, and below a confidence of 0.3 is a search.
    """
    j = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "intent string, retrieval_strategy string, search_query string, confidence double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    df = df.withColumn("_j", j)
    ok = F.col("_j").isNotNull() & F.col("_j._bad").isNull()
    intent = F.when(F.col("_j.intent") == "repository_walk", "repository_overview").when(F.col("_j.intent").isin(*INTENTS), F.col("_j.intent")).otherwise("query")
    confidence = F.when(ok, F.coalesce("_j.confidence", F.lit(0.5))).otherwise(0.0)
    plan = F.when(F.col("_j.retrieval_strategy").isin(*STRATEGIES), F.col("_j.retrieval_strategy")).otherwise("semantic_search")
    plan = F.when(ok, F.when((plan == "repository_walk") & (confidence < 0.3), "semantic_search").otherwise(plan)).otherwise("semantic_search")
    query = F.coalesce(F.nullif(F.when(ok, F.col("_j.search_query")), F.lit("")), F.col(question))
    out = df.withColumns({"intent": F.when(ok, intent).otherwise("query"), "retrieval_strategy": plan, "confidence": confidence})
    return out.withColumn("search_query", F.when(F.col("retrieval_strategy") != "repository_walk", query)).drop("_j")


def parse_batch(df: DataFrame, key: str, col: str) -> DataFrame:
    """Batch responses (a JSON array of file_path and summary, perhaps fenced) to rows."""
    body = F.regexp_extract(F.regexp_replace(F.col(col), r"```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    rows = df.select(key, F.explode(F.from_json(body, "array<struct<file_path:string,summary:string>>")).alias("r"))
    return rows.select(key, "r.file_path", "r.summary").filter("file_path is not null")
