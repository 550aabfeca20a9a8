"""Graph operators over entity and edge tables (id, source_id, target_id, type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename, edge_rank, last_dotted, self_references
from ..schemas import ENTRY_FILENAMES, ENTRY_PATTERNS, ENTRY_SCORES
from ..sources.tables import cut

# Fixed value: references to self that bring a method's parent in.
SELF_REFERENCES = 2


def file_connections(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per connection between files: (source_file, target_file, type, source_id, source_name, target_id, target_name, id).

    Intra-file edges and edges with an unknown end are left out; of edges with equal
    ends and type the first stays; an entity without a name has the last part of its id.
    Entities are needed as (id, name, file_path) only, so neither sources nor vectors
    reach the joins.
    """
    name = F.coalesce("name", last_dotted(F.col("id")))
    at = entities.select("id", name.alias("name"), "file_path")
    src = at.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("file_path").alias("source_file"))
    tgt = at.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file"))
    rows = edges.join(src, "source_id").join(tgt, "target_id").filter("source_file <> target_file")
    keys = ["source_file", "target_file", "type", "source_id", "source_name", "target_id", "target_name"]
    return rows.groupBy(*keys).agg(F.min("id").alias("id"))


def file_edges(entities: DataFrame, edges: DataFrame, lists: bool = False) -> DataFrame:
    """Edges between files: types, dominant type (rank, then name) and the number of distinct connections.

    With ``lists``, also ``connection_list``, the connections in the order of edges: a row
    then grows with the connections of two files, so it is for views of a part of the
    graph; ``file_connections`` has them as rows.
    """
    each = file_connections(entities, edges)
    of = ["id", "source_id", "source_name", "target_id", "target_name", "type"]
    return each.groupBy("source_file", "target_file").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.min_by("type", F.struct(-edge_rank(F.col("type")), F.col("type"))).alias("dominant"),
        F.count("*").alias("connections"),
        *([F.array_sort(F.collect_list(F.struct(*of))).alias("connection_list")] if lists else []),
    )


def entry_points(modules: DataFrame, edges: DataFrame, top: int | None = 10) -> DataFrame:
    """Modules by score: a telling file name, a telling pattern in the source, calls without being called."""
    calls = edges.filter("type = 'CALLS'")
    out = calls.select(F.col("source_id").alias("id")).distinct().withColumn("_out", F.lit(True))
    into = calls.select(F.col("target_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    language = F.when(F.col("language").isin(*ENTRY_FILENAMES), F.col("language")).otherwise("python")
    named, shown = F.lit(False), F.lit(False)
    for k, names in ENTRY_FILENAMES.items():
        if names:
            named |= (language == k) & basename(F.col("file_path")).isin(*names)
        for p in ENTRY_PATTERNS[k]:
            shown |= (language == k) & F.coalesce(F.col("source"), F.lit("")).rlike(p)
    score = lambda c, k: F.when(c, ENTRY_SCORES[k]).otherwise(0)
    df = modules.join(out, "id", "left").join(into, "id", "left")
    zero = F.col("_out").isNotNull() & F.col("_in").isNull()
    df = df.withColumn("score", score(named, "filename") + score(shown, "pattern") + score(zero, "zero_in_degree")).filter("score > 0").drop("_out", "_in")
    return df.orderBy(F.desc("score"), "id").limit(top) if top else df


def bfs(roots: DataFrame, edges: DataFrame, depth: int, types: Sequence[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(root, id, depth, via): nodes that each root reaches, at the least depth.

    All roots advance together, a join and an anti-join a level, so the number of jobs
    is that of levels. Of several ways of one depth, the one of the least edge id counts.
    ``seen`` (root, id) is not entered. Lineage is cut at every level but the last.
    """
    use = edges.filter(F.col("type").isin(*types)) if types else edges
    use = use.filter("target_id is not null").select("id", "source_id", "target_id").withColumnRenamed("id", "edge_id")
    level = roots.select(F.col("id").alias("root"), "id").distinct().select("root", "id", F.lit(0).alias("depth"), F.lit(None).cast(dict(roots.dtypes)["id"]).alias("via"))
    found = cut(level)
    visited = found.select("root", "id")
    if seen is not None:
        visited = visited.unionByName(seen.select("root", "id"))
    frontier = found
    for d in range(1, depth + 1):
        step = frontier.select("root", F.col("id").alias("source_id")).join(use, "source_id")
        step = step.groupBy("root", F.col("target_id").alias("id")).agg(F.min_by("source_id", "edge_id").alias("via"))
        frontier = step.join(visited, ["root", "id"], "left_anti").select("root", "id", F.lit(d).alias("depth"), "via")
        if d < depth:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        found = found.unionByName(frontier)
        visited = visited.unionByName(frontier.select("root", "id"))
    return found


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id), of any type."""
    return edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at neither end of an edge."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def neighbours(nodes: DataFrame, edges: DataFrame, without: Sequence[str] = ("IMPORTS",)) -> DataFrame:
    """(id, neighbour), both ways, without edges of the given types."""
    use = edges.filter(~F.col("type").isin(*without)) if without else edges
    both = use.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour")).unionByName(
        use.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour"))
    )
    return both.filter("id <> neighbour").distinct().join(nodes.select("id"), "id", "left_semi")


def shortest_path(edges: DataFrame, start, end, most: int = 20) -> DataFrame:
    """One row (hops, path) of an undirected shortest path, or none; ties by the least node before."""
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    kind = dict(edges.dtypes)["source_id"]
    frontier = cut(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.array(F.lit(start).cast(kind)).alias("path")))
    visited = frontier.select("id")
    for _ in range(most + 1):
        hit = frontier.filter(F.col("id") == F.lit(end))
        if not hit.isEmpty():
            return hit.select((F.size("path") - 1).alias("hops"), "path")
        step = frontier.withColumnRenamed("id", "source_id").join(both, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min_by("path", "source_id").alias("path"))
        frontier = cut(step.join(visited, "id", "left_anti").withColumn("path", F.concat("path", F.array("id"))))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("id"))
    return frontier.filter("false").select((F.size("path") - 1).alias("hops"), "path")


def isolated(entities: DataFrame, edges: DataFrame, children: DataFrame) -> DataFrame:
    """Entities without calls or inheritance, nor any in the two levels that they contain."""
    tied = edges.filter(F.col("type").isin("CALLS", "INHERITS", "IMPLEMENTS"))
    busy = tied.select(F.col("source_id").alias("id")).unionByName(tied.select(F.col("target_id").alias("id"))).distinct()
    one = children.select(F.col("parent_id").alias("id"), F.col("id").alias("child"))
    two = one.join(one.select(F.col("id").alias("child"), F.col("child").alias("grand")), "child").select("id", F.col("grand").alias("child"))
    below = one.unionByName(two).join(busy.withColumnRenamed("id", "child"), "child", "left_semi").select("id").distinct()
    return entities.join(busy, "id", "left_anti").join(below, "id", "left_anti")


def expand(core: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id, role, depth, via): parent, callees, callers, bases and children of each core entity.

    Roles come in this order and share a seen set per core, which is handed to each
    traversal as visited, so that nothing is entered twice. Parent: kept when at least
    two core entities share it, or when the entity is a method whose source refers to
    itself twice or more, and the containing edge exists. Without a ``source`` column
    only the first holds.
    """
    roots = cut(core.select("id"))
    has = edges.filter("type = 'CONTAINS'").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("id"))
    refers = (F.col("type") == "method") & (self_references(F.col("source")) >= SELF_REFERENCES) if "source" in entities.columns else F.lit(False)
    at = entities.select("id", "parent_id", F.coalesce(refers, F.lit(False)).alias("_refers"))
    up = roots.join(at, "id").filter("parent_id is not null").join(roots.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    up = up.withColumn("_n", F.count("*").over(W.partitionBy("parent_id"))).filter("_n >= 2 or _refers").join(has, ["parent_id", "id"], "left_semi")
    out = cut(up.select(F.col("id").alias("root"), F.col("parent_id").alias("id"), F.lit("parent").alias("role"), F.lit(1).alias("depth"), F.col("id").alias("via")))

    def add(rows: DataFrame, role: str) -> None:
        nonlocal out
        seen = roots.select(F.col("id").alias("root"), "id").unionByName(out.select("root", "id"))
        rows = rows.filter("depth > 0").join(seen, ["root", "id"], "left_anti")
        out = out.unionByName(cut(rows.select("root", "id", F.lit(role).alias("role"), "depth", "via")))

    add(bfs(roots, edges, 3, ["CALLS", "INSTANTIATES"], out.select("root", "id")), "callee")
    calls = edges.filter("type = 'CALLS'").select(F.col("source_id").alias("id"), F.col("target_id").alias("root"))
    add(calls.join(roots.select(F.col("id").alias("root")), "root", "left_semi").distinct().select("root", "id", F.lit(1).alias("depth"), F.col("root").alias("via")), "caller")
    add(bfs(roots, edges, 2, ["INHERITS", "IMPLEMENTS"], out.select("root", "id")), "base")
    tied = edges.filter(F.col("type").isin("CALLS", "IMPORTS"))
    lone = entities.filter("type = 'module'").select("id").join(roots, "id", "left_semi")
    lone = orphans(lone, tied).select(F.col("id").alias("root"))
    add(has.select(F.col("parent_id").alias("root"), "id").join(lone, "root", "left_semi").select("root", "id", F.lit(1).alias("depth"), F.col("root").alias("via")), "child")
    return out


def audit(expanded: DataFrame, edges: DataFrame) -> DataFrame:
    """Expanded rows that no edge accounts for; must be empty."""
    pairs = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).filter("b is not null")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return expanded.join(pairs, (F.col("via") == F.col("a")) & (F.col("id") == F.col("b")), "left_anti")


def ancestor_edges(entities: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hop, edge_id, type, source_id): edges that end at one of the ``hops`` nearest parents of an entity, or at itself (hop 0)."""
    own = entities.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("hop"))
    chain = own.unionByName(ancestors(entities, hops))
    into = edges.select(F.col("id").alias("edge_id"), "type", "source_id", F.col("target_id").alias("ancestor"))
    return chain.join(into, "ancestor").select("id", "hop", "edge_id", "type", "source_id")


def ancestors(entities: DataFrame, hops: int = 3) -> DataFrame:
    """(id, ancestor, hop) up to ``hops`` parents."""
    up = entities.select("id", "parent_id")
    out = level = up.filter("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("hop"))
    for h in range(2, hops + 1):
        step = up.select(F.col("id").alias("ancestor"), F.col("parent_id").alias("next")).filter("next is not null")
        level = level.join(step, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(h).alias("hop"))
        out = out.unionByName(level)
    return out
