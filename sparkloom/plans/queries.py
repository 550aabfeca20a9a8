"""One query per operator over the fixed tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors
from ..operators import citations as C
from ..operators import extract as X
from ..operators import extract_ts as XT
from ..operators import graph as G
from ..operators import memory as M
from ..operators import overview as O
from ..operators import resolve as V
from ..operators import retrieval as R
from ..operators import vector_index as VI
from ..schemas import KNOWN_EXTENSIONS, SUPPORTED_EXTENSIONS
from ..sources import tables as S
from . import accounts, jobs, texts  # noqa: F401  they register their queries
from . import derived as D
from .derived import with_
from .registry import ORACLES, QUERIES, query  # noqa: F401


#: A fixed query vector: what is asked is a parameter of the search, not of the data.
ASKED = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_V = "[" + ",".join(map(str, ASKED)) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_V})"


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return R.search(S.read(spark, d, "embeddings"), ASKED, 10, id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3) ORDER BY {_COS} DESC, vec_id LIMIT 5")
def vector_topk_filtered(spark, d):
    return R.search(S.read(spark, d, "embeddings"), ASKED, 5, F.col("label").isin(1, 3), "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


_NEAREST = """SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, x.vec_id AS id, s AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, x.vec_id) AS rank
  FROM embeddings q JOIN embeddings x ON x.vec_id <> q.vec_id, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS s) WHERE q.vec_id % 20 = 0) WHERE rank <= 10"""


def _nearest(spark, d, probes):
    rows = S.read(spark, d, "embeddings")
    index = VI.build(rows, S.place(spark, "vector_index"), "vec_id")
    found = VI.search(spark, index, rows.filter("vec_id % 20 = 0"), 10, probes, "vec_id", others=True)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(_NEAREST)
def vector_index_exact(spark, d):
    """Many queries in one plan, exactly: cells that cannot hold a nearer row are not read."""
    return _nearest(spark, d, None)


@query()
def vector_index_probed(spark, d):
    """The same from the 24 nearest cells of each query: what recall and reads come to is tested."""
    return _nearest(spark, d, 24)


@query(f"SELECT round(max(s) - min(s), 6) AS gap FROM (SELECT {_COS} AS s FROM embeddings ORDER BY s DESC LIMIT 2)")
def score_gap(spark, d):
    top = R.search(S.read(spark, d, "embeddings"), ASKED, 2, id_col="vec_id")
    return top.agg(F.round(F.max("score") - F.min("score"), 6).alias("gap"))


@query("SELECT label, count(*) AS n, count(*) FILTER (WHERE embedding IS NULL) AS n_null, min(len(embedding)) AS lo, max(len(embedding)) AS hi FROM embeddings GROUP BY label")
def embedding_integrity(spark, d):
    e = S.read(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("n_null"), F.min(F.size("embedding")).cast("long").alias("lo"), F.max(F.size("embedding")).cast("long").alias("hi"))


@query(with_("edges", "SELECT type, count(*) AS n FROM edges GROUP BY type"))
def edge_type_counts(spark, d):
    return D.edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS repo, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS customers FROM nation")
def repo_counts_zero_fill(spark, d):
    n = S.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo"))
    s = S.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("repo")).agg(F.count("*").alias("suppliers"))
    c = S.read(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("repo")).agg(F.count("*").alias("customers"))
    return n.join(s, "repo", "left").join(c, "repo", "left").na.fill(0)


@query(with_("entities", "SELECT file_path, count(*) FILTER (WHERE type <> 'module') AS children FROM entities GROUP BY file_path"))
def child_counts(spark, d):
    return D.entities(spark, d).groupBy("file_path").agg(F.count_if(F.col("type") != "module").alias("children"))


@query(with_("entities", "SELECT parent_id, count(*) AS n FROM entities WHERE type = 'class' GROUP BY parent_id HAVING count(*) >= 2"))
def shared_parents(spark, d):
    w = F.count("*").over(W.partitionBy("parent_id"))
    return D.entities(spark, d).filter("type = 'class'").withColumn("n", w).filter("n >= 2").select("parent_id", "n").distinct()


_FILE_EDGES = """+ x AS (
  SELECT DISTINCT s.file_path AS source_file, t.file_path AS target_file, e.type, e.source_id, e.target_id FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id WHERE s.file_path <> t.file_path)"""


@query(with_("entities edges", _FILE_EDGES + """ SELECT source_file, target_file, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
  arg_min(type, lpad((9 - CASE type WHEN 'CALLS' THEN 4 WHEN 'INHERITS' THEN 3 WHEN 'IMPLEMENTS' THEN 2 WHEN 'INSTANTIATES' THEN 2 WHEN 'IMPORTS' THEN 1 ELSE 0 END)::VARCHAR, 2, '0') || type) AS dominant, count(*) AS connections FROM x GROUP BY ALL"""))
def file_graph_edges(spark, d):
    return G.file_edges(D.entities(spark, d), D.edges(spark, d))


@query(with_("entities edges", """SELECT s.file_path AS source_file, t.file_path AS target_file, e.type, e.source_id, s.name AS source_name, e.target_id, t.name AS target_name, min(e.id) AS id
  FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id WHERE s.file_path <> t.file_path GROUP BY ALL"""))
def file_graph_connections(spark, d):
    return G.file_connections(D.entities(spark, d), D.edges(spark, d))


@query(with_("entities edges", _FILE_EDGES + """, y AS (SELECT s.file_path AS source_file, t.file_path AS target_file, e.type, s.name AS a, t.name AS b, min(e.id) AS id FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id
  WHERE s.file_path <> t.file_path GROUP BY e.type, e.source_id, e.target_id, s.file_path, t.file_path, s.name, t.name) SELECT source_file, target_file, string_agg(a || ' ' || type || ' ' || b, chr(10) ORDER BY id) AS listed FROM y GROUP BY ALL"""))
def file_graph_lists(spark, d):
    each = G.file_edges(D.entities(spark, d), D.edges(spark, d), lists=True)
    line = F.transform("connection_list", lambda c: F.concat_ws(" ", c["source_name"], c["type"], c["target_name"]))
    return each.select("source_file", "target_file", F.array_join(line, "\n").alias("listed"))


@query(with_("edges", """+ calls AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'CALLS') SELECT id, score FROM (SELECT 'c' || k AS id, ((CASE k % 5 WHEN 0 THEN 10 ELSE 0 END) + (CASE k % 3 WHEN 0 THEN 5 ELSE 0 END)
    + (CASE WHEN 'c' || k IN (SELECT source_id FROM calls) AND 'c' || k NOT IN (SELECT target_id FROM calls) THEN 3 ELSE 0 END))::INTEGER AS score FROM (SELECT c_custkey AS k FROM customer)) WHERE score > 0 ORDER BY score DESC, id LIMIT 10"""))
def entry_points(spark, d):
    k = F.col("c_custkey")
    ts = k % 2 == 1
    name = F.when(k % 5 == 0, F.when(ts, "index.ts").otherwise("main.py")).otherwise("other.txt")
    source = F.when(k % 3 == 0, F.when(ts, "app.listen (3000)").otherwise("if __name__ == '__main__':\n    run()")).otherwise("x = 1")
    m = S.read(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(F.lit("src/"), name).alias("file_path"), F.when(ts, "typescript").otherwise("python").alias("language"), source.alias("source"))
    return G.entry_points(m, D.edges(spark, d)).select("id", F.col("score").cast("int").alias("score"))


def _roots(spark, d):
    return D.entities(spark, d).filter(F.col("id").isin("c1", "c2", "c5")).select("id")


_BFS = """+ roots AS (SELECT id FROM entities WHERE id IN ('c1', 'c2', 'c5')), r AS (
  SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT r.root, e.target_id, r.depth + 1 FROM r JOIN edges e ON e.source_id = r.id WHERE r.depth < {0} {1})"""


@query(with_("entities edges", _BFS.format(3, "") + " SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id", True))
def bfs_depth(spark, d):
    return G.bfs(_roots(spark, d), D.edges(spark, d), 3).select("root", "id", "depth")


@query(with_("entities edges", _BFS.format(4, "AND e.type IN ('CALLS', 'IMPORTS')") + " SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id", True))
def bfs_typed(spark, d):
    return G.bfs(_roots(spark, d), D.edges(spark, d), 4, ["CALLS", "IMPORTS"]).select("root", "id", "depth")


@query(with_("entities edges", _BFS.format(1, "") + " SELECT e.* FROM edges e WHERE e.source_id IN (SELECT id FROM r) AND e.target_id IN (SELECT id FROM r)", True))
def induced_edges(spark, d):
    nodes = G.bfs(_roots(spark, d), D.edges(spark, d), 1).select("id").distinct()
    return G.induced(nodes, D.edges(spark, d)).select("id", "source_id", "target_id", "type")


@query(with_("entities edges", "SELECT id, type FROM entities WHERE id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)"))
def orphan_entities(spark, d):
    return G.orphans(D.entities(spark, d), D.edges(spark, d)).select("id", "type")


@query(with_("entities edges", "SELECT DISTINCT a AS id, b AS neighbour FROM (SELECT source_id a, target_id b FROM edges WHERE type <> 'IMPORTS' UNION SELECT target_id, source_id FROM edges WHERE type <> 'IMPORTS') WHERE a IN (SELECT id FROM entities) AND a <> b"))
def undirected_neighbours(spark, d):
    return G.neighbours(D.entities(spark, d), D.edges(spark, d))


@query(with_("edges", """+ b AS (SELECT source_id s, target_id t FROM edges WHERE type = 'CALLS' UNION SELECT target_id, source_id FROM edges WHERE type = 'CALLS'),
  r AS (SELECT 'c1' AS id, 0 AS hops UNION SELECT b.t, r.hops + 1 FROM r JOIN b ON b.s = r.id WHERE r.hops < 8) SELECT min(hops) AS hops FROM r WHERE id = 'c77' HAVING min(hops) IS NOT NULL""", True))
def shortest_path_length(spark, d):
    return G.shortest_path(D.edges(spark, d).filter("type = 'CALLS'"), "c1", "c77", 8).select("hops")


def _all_edges(spark, d):
    return D.edges(spark, d).unionByName(D.contains(spark, d))


#: Methods refer to themselves up to three times, by their number.
_SOURCE = "type || ' ' || name || CASE WHEN type = 'method' THEN repeat(' self.x', (substr(id, 2)::BIGINT % 4)::INT) ELSE '' END"

#: A module without calls, all methods of a file, and one method of every file: some of those bring their parent in by what they refer to.
_CORE = """core AS (SELECT id FROM entities WHERE id = 'n8' OR file_path = 'src/n7.py' AND type = 'method' UNION SELECT 'c' || min(substr(id, 2)::BIGINT) FROM entities WHERE type = 'method' GROUP BY file_path)"""


def _sourced(e):
    refs = F.expr("repeat(' self.x', int(substr(id, 2) % 4))")
    return e.withColumn("source", F.concat("type", F.lit(" "), "name", F.when(F.col("type") == "method", refs).otherwise("")))


def _core(spark, d):
    e = D.entities(spark, d)
    methods = e.filter("type = 'method'")
    least = methods.groupBy("file_path").agg(F.min(F.substring("id", 2, 20).cast("long")).alias("k")).select(F.concat(F.lit("c"), "k").alias("id"))
    return e.filter("id = 'n8'").select("id").unionByName(methods.filter("file_path = 'src/n7.py'").select("id")).unionByName(least).distinct()


#: Roles of the core's neighbours; a role does not enter what roles before it hold.
_EXPAND = """parent AS (SELECT e.id AS root, e.parent_id AS id FROM core JOIN entities e USING (id) WHERE e.parent_id IS NOT NULL AND e.parent_id NOT IN (SELECT id FROM core)
    AND (e.type = 'method' AND substr(e.id, 2)::BIGINT % 4 >= 2 OR e.parent_id IN (SELECT p.parent_id FROM core JOIN entities p USING (id) GROUP BY 1 HAVING count(*) >= 2))),
  r1 AS (SELECT id AS root, id, 0 AS depth FROM core UNION SELECT r.root, e.target_id, r.depth + 1 FROM r1 r JOIN links e ON e.source_id = r.id AND e.type IN ('CALLS', 'INSTANTIATES')
    WHERE r.depth < 3 AND NOT EXISTS (SELECT 1 FROM parent p WHERE p.root = r.root AND p.id = e.target_id)),
  callee AS (SELECT root, id, min(depth) AS depth FROM r1 GROUP BY ALL HAVING min(depth) > 0),
  s2 AS (SELECT id AS root, id FROM core UNION SELECT * FROM parent UNION SELECT root, id FROM callee),
  caller AS (SELECT DISTINCT e.target_id AS root, e.source_id AS id FROM links e JOIN core ON core.id = e.target_id WHERE e.type = 'CALLS' AND (e.target_id, e.source_id) NOT IN (SELECT (root, id) FROM s2)),
  s3 AS (SELECT * FROM s2 UNION SELECT * FROM caller),
  r2 AS (SELECT id AS root, id, 0 AS depth FROM core UNION SELECT r.root, e.target_id, r.depth + 1 FROM r2 r JOIN links e ON e.source_id = r.id AND e.type IN ('INHERITS', 'IMPLEMENTS')
    WHERE r.depth < 2 AND (r.root = e.target_id OR (r.root, e.target_id) NOT IN (SELECT (root, id) FROM s3))),
  base AS (SELECT root, id, min(depth) AS depth FROM r2 GROUP BY ALL HAVING min(depth) > 0),
  s4 AS (SELECT * FROM s3 UNION SELECT root, id FROM base),
  child AS (SELECT e.source_id AS root, e.target_id AS id FROM links e JOIN core ON core.id = e.source_id JOIN entities m ON m.id = core.id AND m.type = 'module' WHERE e.type = 'CONTAINS'
    AND core.id NOT IN (SELECT source_id FROM links WHERE type IN ('CALLS', 'IMPORTS') UNION SELECT target_id FROM links WHERE type IN ('CALLS', 'IMPORTS')) AND (e.source_id, e.target_id) NOT IN (SELECT (root, id) FROM s4)),
  roles AS (SELECT root, id, 'parent' AS role, 1 AS depth FROM parent UNION ALL SELECT root, id, 'callee', depth FROM callee UNION ALL SELECT root, id, 'caller', 1 FROM caller
    UNION ALL SELECT root, id, 'base', depth FROM base UNION ALL SELECT root, id, 'child', 1 FROM child)"""


@query(with_("entities edges links", "+ " + _CORE + ", " + _EXPAND + " SELECT * FROM roles", True))
def expand_roles(spark, d):
    return G.expand(_core(spark, d), _sourced(D.entities(spark, d)), _all_edges(spark, d)).select("root", "id", "role", "depth")


@query(with_("entities edges links", "+ " + _CORE + ", " + _EXPAND + """ SELECT role, count(*) AS n, count(*) FILTER (WHERE (root, id) NOT IN (SELECT (source_id, target_id) FROM links UNION SELECT (target_id, source_id) FROM links)) AS apart FROM roles GROUP BY role""", True))
def expansion_audit(spark, d):
    e = _all_edges(spark, d)
    found = G.expand(_core(spark, d), _sourced(D.entities(spark, d)), e)
    lost = G.audit(found, e).groupBy("role").agg(F.count("*").alias("lost"))  # rows that no edge accounts for: none
    pairs = e.select(F.col("source_id").alias("root"), F.col("target_id").alias("id")).unionByName(e.select(F.col("target_id").alias("root"), F.col("source_id").alias("id"))).distinct().withColumn("near", F.lit(1))
    n = found.join(pairs, ["root", "id"], "left").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("near").isNull()).alias("apart"))
    return n.join(lost, "role", "left").select("role", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"), "apart")


@query(with_("edges", "SELECT DISTINCT source_id AS caller, target_id AS callee FROM edges WHERE type = 'CALLS' AND target_id IN ('c1', 'c2', 'c5')"))
def callers(spark, d):
    e = D.edges(spark, d).filter("type = 'CALLS'").join(_roots(spark, d).withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.select(F.col("source_id").alias("caller"), F.col("target_id").alias("callee")).distinct()


@query(with_("entities edges", """+ busy AS (SELECT source_id AS id FROM edges WHERE type IN ('CALLS', 'INHERITS', 'IMPLEMENTS') UNION SELECT target_id FROM edges WHERE type IN ('CALLS', 'INHERITS', 'IMPLEMENTS')),
  one AS (SELECT parent_id AS id, id AS child FROM entities WHERE parent_id IS NOT NULL), below AS (SELECT * FROM one UNION SELECT a.id, b.child FROM one a JOIN one b ON b.id = a.child)
  SELECT id FROM entities WHERE id NOT IN (SELECT id FROM busy) AND id NOT IN (SELECT id FROM below WHERE child IN (SELECT id FROM busy))"""))
def isolated_entities(spark, d):
    e = D.entities(spark, d)
    return G.isolated(e, D.edges(spark, d), e.filter("parent_id is not null")).select("id")


@query(with_("entities edges", "SELECT a.id, p.id AS ancestor, 1 AS hop FROM entities a JOIN entities p ON p.id = a.parent_id UNION ALL SELECT a.id, p.parent_id, 2 FROM entities a JOIN entities p ON p.id = a.parent_id WHERE p.parent_id IS NOT NULL"))
def ancestor_chain(spark, d):
    return G.ancestors(D.entities(spark, d), 3).select("id", "ancestor", "hop")


@query(with_("entities edges", "SELECT id, name FROM entities WHERE type = 'method' AND id NOT IN (SELECT target_id FROM edges WHERE type = 'CALLS')"))
def unseen_anti(spark, d):
    seen = D.edges(spark, d).filter("type = 'CALLS'").select(F.col("target_id").alias("id"))
    return R.unseen(D.entities(spark, d).filter("type = 'method'"), seen).select("id", "name")


@query(with_("entities edges", "SELECT id FROM edges WHERE type IN ('CALLS', 'INHERITS') AND (source_id IN (SELECT id FROM entities WHERE file_path = 'src/n3.py') OR target_id IN (SELECT id FROM entities WHERE file_path = 'src/n3.py'))"))
def edges_touching(spark, d):
    ids = D.entities(spark, d).filter("file_path = 'src/n3.py'").select("id")
    e = D.edges(spark, d).filter(F.col("type").isin("CALLS", "INHERITS"))
    a = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("id")
    return a.unionByName(e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("id")).distinct()


@query(with_("entities edges", "SELECT e.id, CASE WHEN t.id IS NOT NULL THEN target_id END AS target_id, CASE WHEN t.id IS NULL THEN target_id END AS external_target_name FROM (SELECT id, 'c' || (id % 4000) AS target_id FROM edges) e LEFT JOIN entities t ON t.id = e.target_id"))
def edge_external_split(spark, d):
    e = D.edges(spark, d).select("id", F.concat(F.lit("c"), (F.col("id") % 4000).cast("string")).alias("target_id"))
    return S.split_external(e, D.entities(spark, d)).select("id", "target_id", "external_target_name")


@query("SELECT l_partkey AS id, l_orderkey AS seq, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def insert_keep_first(spark, d):
    rows = S.read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"))
    return S.keep_first(rows, ["id"], ["seq", "line"])


_BUDGET_SQL = """SELECT l_suppkey AS core_id, l_orderkey AS id, l_linenumber AS line, used::BIGINT AS used FROM (
  SELECT *, max((floor(used / 4) > 300)::INTEGER) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS cut FROM (
    SELECT *, 40 + sum(l_quantity::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS used FROM lineitem)) WHERE cut = 0"""


@query(_BUDGET_SQL)
def budget_prefix(spark, d):
    rows = S.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("core_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("chars"), F.col("l_partkey").alias("part"))
    return R.within_budget(rows, ["core_id"], ["line", "id", "part", "chars"], "chars", 40, 300).select("core_id", "id", "line", "used")


@query("SELECT l_partkey AS id, min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END)::INTEGER AS priority FROM lineitem GROUP BY l_partkey")
def priority_merge(spark, d):
    p = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return S.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min(p).alias("priority"))


def _cites(spark, d):
    return C.parse(D.answers(spark, d)).withColumn("start_line", F.col("start_line").cast("long")).withColumn("end_line", F.col("end_line").cast("long"))


@query(with_("answers cites", "SELECT answer_id, raw, file_path, start_line, end_line, pos::BIGINT AS pos FROM cites"))
def citation_parse(spark, d):
    return _cites(spark, d).select("answer_id", "raw", "file_path", "start_line", "end_line", F.col("pos").cast("long").alias("pos"))


@query(with_("answers cites", "SELECT answer_id, raw, dense_rank() OVER (PARTITION BY answer_id ORDER BY pos)::INTEGER AS badge FROM cites"))
def citation_badges(spark, d):
    return C.badges(_cites(spark, d)).select("answer_id", "raw", "badge")


_OVERLAP = """SELECT answer_id, raw, id AS entity_id FROM (SELECT c.answer_id, c.raw, e.id, row_number() OVER (PARTITION BY c.answer_id, c.raw ORDER BY e.end_line - e.start_line, e.id) AS r
  FROM cites c JOIN entities e ON e.file_path = c.file_path AND c.start_line <= e.end_line AND e.start_line <= c.end_line) WHERE r = 1"""


@query(with_("entities answers cites", _OVERLAP))
def range_overlap_smallest(spark, d):
    return C.overlapping(_cites(spark, d), D.entities(spark, d)).select("answer_id", "raw", "entity_id")


@query(with_("entities answers cites", """SELECT answer_id, raw, id AS entity_id, dist AS distance FROM (SELECT c.answer_id, c.raw, e.id, least(abs(e.start_line - c.start_line), abs(e.end_line - c.start_line)) AS dist,
  row_number() OVER (PARTITION BY c.answer_id, c.raw ORDER BY least(abs(e.start_line - c.start_line), abs(e.end_line - c.start_line)), e.id) AS r FROM cites c JOIN entities e ON e.file_path = c.file_path) WHERE r = 1"""))
def nearest_entity(spark, d):
    return C.nearest(_cites(spark, d), D.entities(spark, d)).select("answer_id", "raw", "entity_id", "distance")


@query(with_("entities", """+ c AS (SELECT DISTINCT CASE r WHEN 0 THEN 'src/n' || k || '.py' WHEN 1 THEN 'n' || k || '.py' WHEN 2 THEN 'repo/src/n' || k || '.py' ELSE 'lib/n' || k || '.py' END AS file_path FROM (SELECT c_nationkey AS k, c_custkey % 4 AS r FROM customer)),
  f AS (SELECT DISTINCT file_path AS path FROM entities), m AS (
  SELECT c.file_path, f.path, CASE WHEN f.path = c.file_path THEN 1 WHEN f.path LIKE '%/' || c.file_path OR c.file_path LIKE '%/' || f.path THEN 2 ELSE 3 END AS tier FROM c JOIN f ON
    f.path = c.file_path OR f.path LIKE '%/' || c.file_path OR c.file_path LIKE '%/' || f.path OR regexp_extract(f.path, '[^/]*$') = regexp_extract(c.file_path, '[^/]*$'))
  SELECT file_path, path, tier FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY tier, path) AS r FROM m) WHERE r = 1"""))
def fuzzy_file_match(spark, d):
    k, r = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    head = F.when(r == 0, "src/n").when(r == 1, "n").when(r == 2, "repo/src/n").otherwise("lib/n")
    cited = S.read(spark, d, "customer").select(F.concat(head, k, F.lit(".py")).alias("file_path"))
    return C.match_files(cited, D.entities(spark, d).select(F.col("file_path").alias("path")).distinct())


_KINDS = """hit AS (SELECT answer_id, arg_min(id, lpad((e1 - s1)::VARCHAR, 8, '0') || id) AS entity_id FROM (SELECT c.answer_id, e.id, e.end_line AS e1, e.start_line AS s1 FROM claims c JOIN entities e ON e.file_path = c.file_path AND c.start_line <= e.end_line AND e.start_line <= c.end_line) GROUP BY answer_id),
  x AS (SELECT c.answer_id, h.entity_id, CASE WHEN c.symbol IN (SELECT id FROM entities) THEN c.symbol END AS symbol FROM claims c LEFT JOIN hit h USING (answer_id)),
  flags AS (SELECT source_id, target_id, bool_or(type = 'CONTAINS') AS contains, bool_or(type = 'CALLS') AS calls FROM links GROUP BY ALL),
  kinds AS (SELECT answer_id, CASE WHEN entity_id IS NULL THEN 'unsupported' WHEN symbol IS NULL OR symbol = entity_id OR f.contains THEN 'definition' WHEN f.calls THEN 'call_site' WHEN f.source_id IS NOT NULL THEN 'definition' ELSE 'unsupported' END AS kind
    FROM x LEFT JOIN flags f ON f.source_id = symbol AND f.target_id = entity_id)"""


def _classified(spark, d):
    e = D.entities(spark, d).withColumn("name", F.col("id"))
    return C.classify(C.parse(D.claims(spark, d)), e, _all_edges(spark, d))


@query(with_("entities edges links claims", "+ " + _KINDS + " SELECT answer_id, kind FROM kinds"))
def citation_kinds(spark, d):
    return _classified(spark, d).select("answer_id", "kind")


@query(with_("entities edges links claims", "+ " + _KINDS + " SELECT answer_id, count(*) AS total, count(*) FILTER (WHERE kind = 'unsupported') AS unsupported, round(avg((kind = 'unsupported')::INTEGER), 6) AS hallucination_rate, round(1 - avg((kind = 'unsupported')::INTEGER), 6) AS hit_rate FROM kinds GROUP BY answer_id"))
def citation_report(spark, d):
    return C.report(_classified(spark, d)).select("answer_id", "total", "unsupported", F.round("hallucination_rate", 6).alias("hallucination_rate"), F.round("hit_rate", 6).alias("hit_rate"))


@query(with_("edges", "SELECT DISTINCT type, unnest(list_distinct([source_id, regexp_extract(source_id, '[^.]*$')])) AS source, target FROM (SELECT type, 'py.m.' || source_id AS source_id, unnest(list_distinct(['py.m.' || target_id, target_id])) AS target FROM edges)"))
def edge_name_ways(spark, d):
    e = D.edges(spark, d).select("type", *[F.concat(F.lit("py.m."), c).alias(c) for c in ("source_id", "target_id")])
    return C.edge_names(e).select("type", "source", "target")


@query(with_("answers", r"SELECT answer_id, regexp_replace(regexp_replace(answer, '\[`([^\[\]\s:`]+\.[a-zA-Z0-9]+:\d+(?:-\d+)?)`\]', '[\1]', 'g'), '(?i)\[([^\[\]\s:`]+\.[a-zA-Z0-9]+):(?:start|end)(?:-(?:\d+|start|end))?\]', '', 'g') AS answer FROM answers"))
def citation_clean(spark, d):
    return D.answers(spark, d).select("answer_id", T.sanitize_citations(T.normalise_citations(F.col("answer"))).alias("answer"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1")
def latest_complete(spark, d):
    o = S.read(spark, d, "orders").filter("o_orderstatus = 'F'")
    return M.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH last AS (SELECT o_custkey, o_orderkey, o_orderdate, o_custkey % 25 AS repo_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1),
  repo AS (SELECT o_custkey % 25 AS repo_id, max(o_orderdate) - INTERVAL 400 DAY AS indexed_at FROM orders GROUP BY 1)
  SELECT o_custkey, o_orderkey FROM last JOIN repo USING (repo_id) WHERE o_orderdate >= indexed_at""")
def cache_staleness(spark, d):
    o = S.read(spark, d, "orders").withColumn("repo_id", F.col("o_custkey") % 25)
    entries = o.select("repo_id", "o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("complete"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("repo_indexed_at"))
    return M.cache_lookup(entries, _versions(o), ["repo_id", "o_custkey"]).select("o_custkey", F.col("id").alias("o_orderkey"))


def _versions(orders):
    return orders.groupBy("repo_id").agg((F.max("o_orderdate") - F.expr("INTERVAL 400 DAYS")).alias("indexed_at"))


@query("SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def next_turn_index(spark, d):
    return M.next_turn(S.read(spark, d, "conversations"), "conv_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn > conv_id % 3")
def unsummarised_turns(spark, d):
    t = S.read(spark, d, "conversations")
    through = t.select("conv_id").distinct().withColumn("summarized_through_turn", F.col("conv_id") % 3)
    return M.unsummarised(t, through, "conv_id").select("conv_id", "turn")


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def history_text(spark, d):
    return M.history(S.read(spark, d, "conversations"), "conv_id")


@query("SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def conversation_title(spark, d):
    return M.title(S.read(spark, d, "conversations"), "conv_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n_history(spark, d):
    return M.last_turns(S.read(spark, d, "conversations"), "conv_id", 3).select("conv_id", "turn", "role")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY event_id DESC LIMIT 20")
def recent_conversations(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id")).orderBy(F.desc("event_id")).limit(20)


@query("SELECT DISTINCT user_id, event_type AS category, trim(event_type || (event_id % 3)) AS fact FROM events WHERE event_id % 2 = 1 EXCEPT SELECT user_id, event_type, event_type || (event_id % 3) FROM events WHERE event_id % 2 = 0")
def fact_dedupe(spark, d):
    f = S.read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("category"), F.concat(F.lit(" "), "event_type", (F.col("event_id") % 3).cast("string")).alias("fact"))
    old = f.filter("event_id % 2 = 0").withColumn("fact", F.trim("fact"))
    return M.new_facts(old, f.filter("event_id % 2 = 1"), ["user_id"]).select("user_id", "category", "fact")


@query("SELECT a.event_id, count(b.event_id) AS recent FROM events a LEFT JOIN events b ON a.event_type = b.event_type AND b.ts < a.ts AND b.ts > a.ts - INTERVAL 60 SECOND GROUP BY a.event_id")
def quota_sliding_60s(spark, d):
    return M.sliding_count(S.read(spark, d, "events"), "event_type", "ts").select("event_id", "recent")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) - 1 AS today, (row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) - 1 < 45) AS available FROM events")
def quota_daily(spark, d):
    e = M.daily_count(S.read(spark, d, "events"), "event_type", "ts", "event_id")
    return e.select("event_id", "today", M.available(F.lit(0), F.col("today"), 0, 50).alias("available"))


@query("SELECT n_nationkey AS repo_id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 7)")
def visible_repos(spark, d):
    grants = S.read(spark, d, "customer").select((F.col("c_custkey") % 40).alias("user_id"), F.col("c_nationkey").alias("repo_id"))
    return M.visible_repos(S.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo_id")), grants, 7)


@query("""SELECT s_suppkey AS user_id, s_nationkey AS repo_id, CASE WHEN c.u IS NOT NULL THEN 'owner' WHEN s_nationkey % 2 = 0 THEN 'viewer' ELSE 'denied' END AS decision
  FROM supplier LEFT JOIN (SELECT DISTINCT c_custkey % 100 AS u, c_nationkey AS r FROM customer) c ON c.u = s_suppkey AND c.r = s_nationkey""")
def access_decision(spark, d):
    grants = S.read(spark, d, "customer").select((F.col("c_custkey") % 100).alias("user_id"), F.col("c_nationkey").alias("repo_id"), F.lit("owner").alias("role")).distinct()
    repos = S.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo_id"), F.when(F.col("n_nationkey") % 2 == 0, "ready").otherwise("failed").alias("status"))
    asked = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("repo_id"))
    return M.access(asked, grants, repos).select("user_id", "repo_id", "decision")


@query("SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def job_latest_state(spark, d):
    return M.job_states(S.read(spark, d, "events"), "user_id").select("user_id", F.col("event_type").alias("state"))


_METRIC = """WITH res AS (SELECT l_orderkey AS scenario, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank FROM lineitem),
  rel AS (SELECT DISTINCT l_orderkey AS scenario, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), m AS (
  SELECT r.scenario, coalesce(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 0) AS hits, min(rank) AS first FROM res r JOIN rel USING (scenario, id) GROUP BY r.scenario),
  o AS (SELECT scenario, coalesce(hits, 0) / 3.0 AS precision, coalesce(hits, 0) / n AS recall, coalesce(1.0 / first, 0) AS mrr FROM (SELECT scenario, count(*) AS n FROM rel GROUP BY scenario) LEFT JOIN m USING (scenario))"""


def _metrics(spark, d):
    l = S.read(spark, d, "lineitem")  # noqa: E741
    res = l.select(F.col("l_orderkey").alias("scenario"), F.col("l_partkey").alias("id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("rank"))
    rel = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scenario"), F.col("l_partkey").alias("id")).distinct()
    return M.metrics(res, rel, 3)


@query(_METRIC + " SELECT scenario, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM o")
def precision_recall_mrr(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _metrics(spark, d).select("scenario", r("precision"), r("recall"), r("mrr"))


@query(_METRIC + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM o")
def macro_mean(spark, d):
    return _metrics(spark, d).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr")])


@query("""SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN a.v = e.v THEN 'equal' ELSE 'different' END AS state
  FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) e FULL JOIN (SELECT c_custkey AS k, c_nationkey % 20 AS v FROM customer WHERE c_custkey % 4 <> 0) a ON a.k = e.k""")
def manifest_diff(spark, d):
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return M.diff(c.filter("k % 3 <> 0"), c.filter("k % 4 <> 0").withColumn("v", F.col("v") % 20), ["k"], ["v"])


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'left', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def set_operations(spark, d):
    p = lambda f: S.read(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select("l_partkey")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(p("R").intersect(p("A")), "both").unionByName(n(p("R").subtract(p("A")), "left"))


_SRC = "(CASE p_partkey % 4 WHEN 0 THEN ' HTTP://GitHub.com//Acme/' WHEN 1 THEN 'https://gitlab.com/a//' WHEN 2 THEN '/home/u/' ELSE 'git@host:x/' END || replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '.git' WHEN 1 THEN '//' ELSE '' END)"
_CANON = f"regexp_replace(regexp_replace(regexp_replace(lower(trim({_SRC})), '/+$', ''), '\\.git$', ''), '^http://(github\\.com|gitlab\\.com|bitbucket\\.org)/', 'https://\\1/')"


@query(f"SELECT p_partkey, c AS canonical, substr(sha256(c), 1, 16) AS repo_id, regexp_extract(c, '[^/]*$') AS name FROM (SELECT p_partkey, CASE WHEN instr(c, '://') > 0 THEN substr(c, 1, instr(c, '://') + 2) || regexp_replace(substr(c, instr(c, '://') + 3), '/+', '/', 'g') ELSE c END AS c FROM (SELECT p_partkey, {_CANON} AS c FROM part))")
def canonical_repo_id(spark, d):
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, " HTTP://GitHub.com//Acme/").when(k % 4 == 1, "https://gitlab.com/a//").when(k % 4 == 2, "/home/u/").otherwise("git@host:x/")
    src = F.concat(head, F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.when(k % 3 == 0, ".git").when(k % 3 == 1, "//").otherwise(""))
    return S.read(spark, d, "part").select("p_partkey", T.canonical_source(src).alias("canonical"), T.repo_id(src).alias("repo_id"), T.repo_name(src).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'py.pkg.m' || p_size || '.f' || p_partkey ELSE 'ts.pkg.m' || p_size || '.f' || p_partkey || '_model' END AS module_id FROM part")
def module_ids(spark, d):
    k, m = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    even = F.col("p_partkey") % 2 == 0
    path = F.when(even, F.concat(F.lit("python/pkg/m"), m, F.lit("/f"), k, F.lit(".py"))).otherwise(F.concat(F.lit("typescript/pkg/m"), m, F.lit("/f"), k, F.lit(".model.tsx")))
    return S.read(spark, d, "part").select("p_partkey", T.module_id(path, F.when(even, "python").otherwise("typescript")).alias("module_id"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, CASE WHEN instr(url, '/') > 0 THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, regexp_extract(url, '[^.]*$') AS last FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    return S.read(spark, d, "pages").select("page_id", T.basename(u).alias("base"), T.folder(u).alias("folder"), T.last_dotted(u).alias("last"))


@query("SELECT source, sum(length(text) // 4)::BIGINT AS tokens, max(length(text) // 4) AS most, round(avg(greatest(1, length(text) // 4)), 4) AS mean FROM documents GROUP BY source")
def token_estimates(spark, d):
    t = F.col("text")
    return S.read(spark, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(t)).alias("tokens"), F.max(T.token_estimate(t)).alias("most"), F.round(F.avg(T.token_estimate(t, 1)), 4).alias("mean"))


@query("SELECT p_partkey AS model_id FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS rank FROM part WHERE p_size * 1000 >= 20000 + 512 AND p_brand NOT IN ('Brand#11', 'Brand#12')) ORDER BY rank, p_partkey LIMIT 15")
def model_candidates(spark, d):
    m = S.read(spark, d, "part").select(
        F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("provider"), (F.col("p_size") * 1000).alias("max_context"), F.col("p_partkey").alias("position"),
        F.when(F.col("p_size") % 3 == 0, "fast").when(F.col("p_size") % 3 == 1, "standard").otherwise("reasoning").alias("tier"),
    )
    return M.candidates(m, "standard", 20_000, ["Brand#11", "Brand#12"]).select("model_id").limit(15)


_EXT = ", ".join(f"('{k}', '{v}')" for k, v in KNOWN_EXTENSIONS.items())
_EXTS = [*SUPPORTED_EXTENSIONS, *KNOWN_EXTENSIONS, ".txt"]


@query(f"WITH m(ext, name) AS (VALUES {_EXT}), f AS (SELECT p_size AS repo, [{', '.join(repr(x) for x in _EXTS)}][p_partkey % {len(_EXTS)} + 1] AS ext FROM part) SELECT repo, bool_or(f.ext IN ('.py', '.ts', '.tsx')) AS has_supported, coalesce(string_agg(DISTINCT m.name, ',' ORDER BY m.name), '') AS unsupported FROM f LEFT JOIN m USING (ext) GROUP BY repo")
def language_scan(spark, d):
    from ..sources.repository import scan_languages

    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTS]), (F.col("p_partkey") % len(_EXTS) + 1).cast("int"))
    files = S.read(spark, d, "part").select(F.col("p_size").alias("repo"), F.concat(F.lit("a/b"), ext).alias("path"))
    return scan_languages(files, "repo")


@query(with_("entities", "SELECT c.c_custkey AS k, max(length(e.id)) AS n FROM (SELECT c_custkey, 'n' || c_nationkey || 'x' AS q FROM customer) c JOIN entities e ON c.q LIKE e.id || '%' WHERE e.type = 'module' GROUP BY c.c_custkey"))
def longest_prefix(spark, d):
    q = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("x"))
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.substring(q, F.lit(1), i))).alias("id"))
    return c.join(D.entities(spark, d).filter("type = 'module'").select("id"), "id").groupBy("k").agg(F.max(F.length("id")).cast("long").alias("n"))


@query("SELECT k, round(greatest(0.01, 0.8 - 0.01 * k), 4)::DOUBLE AS score FROM (SELECT vec_id AS k FROM embeddings)")
def synthetic_scores(spark, d):
    return S.read(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.round(R.synthetic_score(F.lit(0.8), F.col("vec_id")), 4).alias("score"))


@query("SELECT event_id, (event_id % 130) AS raw, least(100, greatest(0, event_id % 130 - 10))::INTEGER AS pct, event_type AS message FROM events")
def progress_decode(spark, d):
    m = T.progress_encode(F.col("event_type"), F.col("event_id") % 130 - 10)
    return S.read(spark, d, "events").select("event_id", (F.col("event_id") % 130).alias("raw"), T.progress_pct(m).alias("pct"), T.progress_text(m).alias("message"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'clone' WHEN 2 THEN 'timeout' WHEN 3 THEN 'not_found' ELSE 'other' END AS kind FROM orders")
def error_kinds(spark, d):
    k = F.col("o_orderkey") % 5
    m = F.when(k == 0, "HTTP 429 from service").when(k == 1, "Git Clone failed").when(k == 2, "request Timed out").when(k == 3, "No such file").otherwise("boom")
    return S.read(spark, d, "orders").select("o_orderkey", T.ingest_error_kind(m).alias("kind"))


@query(with_("entities", "SELECT file_path, string_agg('- ' || type || ' ' || name, chr(10) ORDER BY start_line, id) AS bullets FROM entities WHERE type <> 'module' GROUP BY file_path"))
def entity_bullets(spark, d):
    e = D.entities(spark, d).filter("type <> 'module'")
    rows = e.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", F.concat(F.lit("- "), "type", F.lit(" "), "name").alias("b")))).alias("x"))
    return rows.select("file_path", F.array_join(F.transform("x", lambda v: v["b"]), "\n").alias("bullets"))


@query("SELECT l_orderkey, string_agg(l_returnflag, '|' ORDER BY l_linenumber, l_returnflag) AS merged FROM lineitem GROUP BY l_orderkey")
def chunk_merge(spark, d):
    g = S.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["l_returnflag"]), "|").alias("merged"))


@query("SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) = 1")
def unique_names(spark, d):
    return S.read(spark, d, "part").groupBy("p_brand", "p_size", "p_type").agg(F.count("*").alias("n")).filter("n = 1")


@query(with_("edges", """+ v AS (SELECT DISTINCT e.source_id, e.target_id, e.type, x.value FROM edges e JOIN events x ON x.event_id = e.id), e AS (SELECT DISTINCT source_id, target_id, type FROM v WHERE value < 80), a AS (SELECT DISTINCT source_id, target_id, type FROM v WHERE value > 20)
  SELECT coalesce(e.type, a.type) AS type, count(e.type) AS expected, count(a.type) AS found, count(*) FILTER (WHERE e.type IS NOT NULL AND a.type IS NOT NULL) AS matched, round(count(*) FILTER (WHERE e.type IS NOT NULL AND a.type IS NOT NULL) / nullif(count(e.type), 0)::DOUBLE, 6) AS rate
  FROM e FULL JOIN a ON e.source_id = a.source_id AND e.target_id = a.target_id AND e.type = a.type GROUP BY 1"""))
def edge_match_rate(spark, d):
    v = D.edges(spark, d).join(S.read(spark, d, "events").select(F.col("event_id").alias("id"), "value"), "id")
    return O.match_rates(v.filter("value < 80"), v.filter("value > 20"), ["source_id", "target_id", "type"], "type")


#: One step a row of a source: what the batch holds so far, and its number.
_GREEDY = """rows AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents {1}),
  g AS (SELECT source, doc_id, tokens, r, tokens AS used, 0::BIGINT AS batch FROM rows WHERE r = 1 UNION ALL
    SELECT n.source, n.doc_id, n.tokens, n.r, CASE WHEN g.used + n.tokens > {0} THEN n.tokens ELSE g.used + n.tokens END, g.batch + (g.used + n.tokens > {0})::BIGINT FROM g JOIN rows n ON n.r = g.r + 1 AND n.source IS NOT DISTINCT FROM g.source)"""


@query("WITH RECURSIVE " + _GREEDY.format(5000, "") + " SELECT source, doc_id, tokens, batch FROM g")
def token_batches(spark, d):
    return R.token_batches(S.read(spark, d, "documents"), ["source"], ["doc_id"], "text", 5_000)


#: The same under two limits: at most 5 files of 150 tokens of answers each.
_PACKED = """small AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE greatest(1, length(text) // 4) < 600),
  p AS (SELECT source, doc_id, tokens, r, tokens AS used, 150 AS answer, 0::BIGINT AS batch FROM small WHERE r = 1 UNION ALL
    SELECT n.source, n.doc_id, n.tokens, n.r, CASE WHEN p.used + n.tokens > 2000 OR p.answer + 150 > 800 THEN n.tokens ELSE p.used + n.tokens END, CASE WHEN p.used + n.tokens > 2000 OR p.answer + 150 > 800 THEN 150 ELSE p.answer + 150 END,
      p.batch + (p.used + n.tokens > 2000 OR p.answer + 150 > 800)::BIGINT FROM p JOIN small n ON n.r = p.r + 1 AND n.source IS NOT DISTINCT FROM p.source)"""

#: Chunks of the files over 2000 tokens: a step a line, of what the chunk holds so far.
_CHUNKS = """big AS (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE greatest(1, length(text) // 4) > 2000),
  lines AS (SELECT * FROM (SELECT source, doc_id, i, length(x) + (i < n)::INT AS chars FROM (SELECT source, doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i, len(l) AS n FROM big)) WHERE chars > 0),
  c AS (SELECT source, doc_id, i, chars AS used, chars, 0::BIGINT AS chunk FROM lines WHERE i = 1 UNION ALL
    SELECT n.source, n.doc_id, n.i, CASE WHEN c.used + n.chars > 8000 THEN n.chars ELSE c.used + n.chars END, n.chars, c.chunk + (c.used + n.chars > 8000)::BIGINT FROM c JOIN lines n ON n.i = c.i + 1 AND n.doc_id = c.doc_id),
  chunks AS (SELECT source, doc_id, chunk, sum(chars)::BIGINT AS chars, min(i)::INT AS first_line, max(i)::INT AS last_line FROM c GROUP BY ALL)"""


@query("WITH RECURSIVE " + _PACKED + ", " + _CHUNKS + """ SELECT source, doc_id, tokens, 'packed' AS kind, 0::BIGINT AS chunk, 1::BIGINT AS total_chunks, batch FROM p
  UNION ALL SELECT source, doc_id, greatest(1, length(text) // 4), 'single', 0, 1, NULL FROM documents WHERE greatest(1, length(text) // 4) BETWEEN 600 AND 2000
  UNION ALL SELECT source, doc_id, greatest(1, chars // 4), 'chunked', chunk, count(*) OVER (PARTITION BY source, doc_id), NULL FROM chunks""")
def file_batches(spark, d):
    return R.file_batches(S.read(spark, d, "documents"), "source", "doc_id", "text", 4_000, 2_000, 150)


@query("WITH RECURSIVE " + _CHUNKS + " SELECT doc_id, chunk, count(*) OVER (PARTITION BY doc_id) AS total_chunks, first_line, last_line, chars FROM chunks")
def source_chunks(spark, d):
    docs = S.read(spark, d, "documents").filter(T.token_estimate(F.col("text"), 1) > 2000)
    return R.source_chunks(docs, ["doc_id"], "text", 2_000).drop("text")


@query(with_("entities edges links", f"""+ scored AS (SELECT 'c' || vec_id AS id, {_COS} AS score FROM embeddings), ranked AS (SELECT s.id, row_number() OVER (ORDER BY s.score DESC, s.id) AS rank FROM scored s JOIN entities USING (id) WHERE s.score IS NOT NULL QUALIFY rank <= 5),
  core AS (SELECT id FROM ranked), {_EXPAND},
  items AS (SELECT id, 1 AS priority, rank AS seq FROM ranked UNION ALL SELECT r.id, CASE role WHEN 'callee' THEN CASE depth WHEN 1 THEN 2 WHEN 2 THEN 4 END WHEN 'child' THEN 2 WHEN 'caller' THEN 3 WHEN 'parent' THEN 5 ELSE 6 END, k.rank FROM roles r JOIN ranked k ON k.id = r.root),
  best AS (SELECT id, min(priority) AS priority, arg_min(seq, priority * 1000 + seq) AS seq FROM items WHERE priority IS NOT NULL GROUP BY id),
  shown AS (SELECT b.*, length('--- Entity: ' || type || ' ' || name || ' ---' || chr(10) || 'Citation: [' || file_path || ':' || start_line || '-' || end_line || ']' || chr(10) || 'Source Code:' || chr(10) || {_SOURCE} || chr(10) || chr(10)) AS chars FROM best b JOIN entities USING (id)),
  run AS (SELECT *, 400 + sum(chars) OVER w AS used FROM shown WINDOW w AS (ORDER BY priority, seq, id ROWS UNBOUNDED PRECEDING)), cut AS (SELECT *, max((used // 4 > 1500)::INTEGER) OVER (ORDER BY priority, seq, id ROWS UNBOUNDED PRECEDING) AS over FROM run)
  SELECT id, priority::INTEGER AS priority, seq::INTEGER AS seq, used::BIGINT AS used FROM cut WHERE over = 0""", True))
def retrieve_context(spark, d):
    e = D.entities(spark, d)
    v = S.read(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return R.retrieve(_sourced(e.join(v, "id", "left")), _all_edges(spark, d), ASKED, 5, 1500, 400)


_PYTHON = """\"\"\"Doc.\"\"\"
from n{m} import base{m} as other, Root{m} as Up
import os
LIMIT = 3

def base{n}(x):
    return x

class Root{n}:
    def __init__(self):
        self.v = 1
"""
_PYTHON_CLASS = """
class S{k}(Up):
    \"\"\"S.\"\"\"
    def run(self, a):
        other(a)
        self.step()
        item = Root{n}()
        return item
    def step(self):
        return base{n}(1)
"""
_TYPESCRIPT = """import {{ Shape{m} as Up, make{m} }} from './m{m}';
export interface Shape{n} {{
  area(): number;
}}
export class Maker{n} {{
}}
export function make{n}(x: number) {{
  return x;
}}
"""
_TYPESCRIPT_CLASS = """
/** T. */
export class T{k} implements Up {{
  area() {{
    return make{m}(1);
  }}
  twice() {{
    const t = new Maker{n}();
    return this.area();
  }}
}}
"""


def _written(text: str):
    """The text with the numbers n, m and k of a row in it."""
    out = F.lit(text.replace("{{", "{").replace("}}", "}"))
    for x in "nmk":
        out = F.replace(out, F.lit("{" + x + "}"), F.col(x).cast("string"))
    return out


def _sources(spark, d):
    """A Python and a TypeScript file per nation, with a class in either for each supplier; they import the next nation's."""
    s = S.read(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))
    rows = S.read(spark, d, "nation").select(F.col("n_nationkey").alias("n")).join(s, "n", "left").withColumn("m", (F.col("n") + 1) % 25)
    rows = rows.withColumn("k", F.coalesce("k", F.lit(-1)))
    out = None
    for name, whole, part in (("python/n{n}.py", _PYTHON, _PYTHON_CLASS), ("typescript/m{n}.ts", _TYPESCRIPT, _TYPESCRIPT_CLASS)):
        body = F.array_sort(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", _written(part).alias("t")))))
        per = rows.groupBy(_written(name).alias("file_path"), _written(whole).alias("head")).agg(body.alias("x"))
        per = per.select(F.lit("r").alias("repo_id"), "file_path", F.concat("head", F.array_join(F.transform("x", lambda v: v["t"]), "")).alias("content"))
        out = per if out is None else out.unionByName(per)
    return out


def _facts(spark, d):
    facts = S.cut(XT.facts(_sources(spark, d)))
    return facts, S.cut(X.entities(facts))


#: Members of a class, by their kind: each calls as often, and has as many methods, as ``_MEMBER_SQL`` says.
_MEMBERS = [
    "  r{p} = /[{'\"]\\//;\n",
    "  h{p} = async (x: number): Promise<void> => { await this.go(x); };\n",
    "  @Hook({ at: '}' }) m{p}<T extends { k: T }>(x: T[] = []): Map<string, { v: T }> { return wrap<T>(x / 2 / 3, `a ${x ? `b ${inner()}` : '}'} c`); }\n",
    "  /** Two. */\n  o{p}(a: string): void;\n  o{p}(a: any) { if (/}/.test(a)) { this.x.put(a); } }\n",
    "  static get g{p}() { return new Box<number>(1); }\n",
]


def _members(spark, d):
    """A TypeScript file per supplier, with a member of its class for every part that it has; which one follows from the part."""
    p = S.read(spark, d, "part")
    n = max(1, S.read(spark, d, "supplier").count())
    text = F.lit("")
    for i, m in enumerate(_MEMBERS):
        text = F.when(F.col("p_size") % 5 == i, F.replace(F.lit(m), F.lit("{p}"), F.col("p_partkey").cast("string"))).otherwise(text)
    rows = p.select((F.col("p_partkey") % n).alias("k"), F.struct("p_partkey", text.alias("t")).alias("m"))
    per = rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["t"]), "").alias("body"))
    name = lambda a, b: F.concat(F.lit(a), F.col("k").cast("string"), F.lit(b))
    return per.select(F.lit("r").alias("repo_id"), name("src/s", ".ts").alias("file_path"), F.concat(name("export class S", " extends Base<{ a: '}' }> {\n"), "body", F.lit("}\nexport const last = () => done();\n")).alias("content"))


@query("""WITH p AS (SELECT p_partkey % greatest(1, (SELECT count(*) FROM supplier)) AS k, p_partkey, p_size % 5 AS m FROM part)
  SELECT 'src/s' || k || '.ts' AS file_path, count(*) FILTER (m >= 2) AS methods, count(*) FILTER (m = 3) AS documented, (2 * count(*) FILTER (m = 2) + count(*) FILTER (m = 3) + count(*) FILTER (m = 4) + 1)::BIGINT AS calls,
    count(*) FILTER (m = 4) AS sites, 1::BIGINT AS bases, (count(*) FILTER (m <> 3) + 3 * count(*) FILTER (m = 3) + 2)::INT AS end_line FROM p GROUP BY k""")
def extract_members(spark, d):
    """Facts of sources of odd members: patterns, nested templates, arrow functions, overloads, decorators and generics."""
    f = XT.facts(_members(spark, d))
    e = X.entities(f)
    per = e.groupBy("file_path").agg(F.count_if(F.col("type") == "method").alias("methods"), F.count_if((F.col("type") == "method") & F.col("has_docstring")).alias("documented"), F.max(F.when(F.col("type") == "class", F.col("end_line"))).alias("end_line"))
    more = f.groupBy("file_path").agg(*[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("call", "site", "base")])
    return per.join(more, "file_path")


_PER = "per AS (SELECT n_nationkey AS n, (n_nationkey + 1) % 25 AS m, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey)"


@query(f"""WITH {_PER} SELECT 'python/n' || n || '.py' AS file_path, unnest(['module', 'function', 'class', 'method', 'variable']) AS type, unnest([1, 1, 1 + s, 1 + 2 * s, 1 + s]) AS n, unnest([1, 0, s, 0, 0]) AS documented FROM per
  UNION ALL SELECT 'typescript/m' || n || '.ts', unnest(['module', 'function', 'class', 'method', 'interface']), unnest([1, 1, 1 + s, 1 + 2 * s, 1]), unnest([(s > 0)::INT, 0, s, 0, 0]) FROM per""")
def extract_entities(spark, d):
    _, e = _facts(spark, d)
    return e.groupBy("file_path", "type").agg(F.count("*").alias("n"), F.count_if("has_docstring").alias("documented"))


@query(f"WITH {_PER} SELECT 'python/n' || n || '.py' AS file_path, 4 + 4 * s AS n FROM per UNION ALL SELECT 'typescript/m' || n || '.ts', 4 + 3 * s FROM per")
def extract_contains(spark, d):
    _, e = _facts(spark, d)
    return X.contains(e).groupBy("file_path").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_nationkey + 1) % 25 AS m FROM supplier), p AS (SELECT n_nationkey AS n, (n_nationkey + 1) % 25 AS m FROM nation)
  SELECT 'py.n' || n AS source_id, 'py.n' || m || '.' || unnest(['base', 'Root']) || m AS target_id, 'IMPORTS' AS type FROM p
  UNION ALL SELECT 'ts.m' || n, 'ts.m' || m || '.' || unnest(['Shape', 'make']) || m, 'IMPORTS' FROM p
  UNION ALL SELECT 'py.n' || n || '.S' || k, 'py.n' || m || '.Root' || m, 'INHERITS' FROM s UNION ALL SELECT 'ts.m' || n || '.T' || k, 'ts.m' || m || '.Shape' || m, 'IMPLEMENTS' FROM s
  UNION ALL SELECT 'py.n' || n || '.S' || k || '.run', unnest(['py.n' || m || '.base' || m, 'py.n' || n || '.S' || k || '.step', 'py.n' || n || '.Root' || n || '.__init__']), 'CALLS' FROM s
  UNION ALL SELECT 'py.n' || n || '.S' || k || '.step', 'py.n' || n || '.base' || n, 'CALLS' FROM s UNION ALL SELECT 'py.n' || n || '.S' || k || '.run', 'py.n' || n || '.Root' || n, 'INSTANTIATES' FROM s
  UNION ALL SELECT 'ts.m' || n || '.T' || k || '.area', 'ts.m' || m || '.make' || m, 'CALLS' FROM s UNION ALL SELECT 'ts.m' || n || '.T' || k || '.twice', 'ts.m' || n || '.T' || k || '.area', 'CALLS' FROM s
  UNION ALL SELECT 'ts.m' || n || '.T' || k || '.twice', 'ts.m' || n || '.Maker' || n, 'INSTANTIATES' FROM s""")
def resolve_edges(spark, d):
    return V.resolve(*_facts(spark, d)).select("source_id", "target_id", "type")


@query("SELECT 'python/n' || n_nationkey || '.py' AS file_path, unnest(['other', 'Up']) AS local, unnest(['py.n' || m || '.base' || m, 'py.n' || m || '.Root' || m]) AS target_id FROM (SELECT n_nationkey, (n_nationkey + 1) % 25 AS m FROM nation)")
def import_aliases(spark, d):
    facts, e = _facts(spark, d)
    return V.symbols(facts, e).filter("file_path like '%.py'").select("file_path", "local", "target_id")
