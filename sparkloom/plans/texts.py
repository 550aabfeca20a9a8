"""Queries of answers, prompts, overviews and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as W
from ..operators import graph as G
from ..operators import overview as O
from ..operators import retrieval as R
from ..operators import table_functions as TF
from ..operators import trees, walk
from ..sources import tables as S
from . import derived as D
from .derived import with_
from .registry import query


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'quota' WHEN 1 THEN 'too_large' WHEN 2 THEN 'auth' WHEN 3 THEN 'provider' WHEN 4 THEN 'quota' ELSE 'too_large' END AS kind FROM orders")
def model_error_kinds(spark, d):
    k = F.col("o_orderkey") % 6
    said = ("Error 429", "Request too large for it", "401: no key", "connection reset", "Tokens per Day reached", "MAXIMUM CONTEXT LENGTH is 8192")
    m = F.element_at(F.array(*map(F.lit, said)), (k + 1).cast("int"))
    return S.read(spark, d, "orders").select("o_orderkey", W.model_error_kind(m).alias("kind"))


_RAW = """CASE p_partkey % 8 WHEN 0 THEN p_name || ' <answer_json>{"status": "answered", "answer": "short"}</answer_json>' WHEN 1 THEN '<ANSWER_JSON> {"status": "answered", "answer": "' || p_type || '"} </ANSWER_JSON>'
  WHEN 2 THEN p_name WHEN 3 THEN p_name || ' {"a": 1} {"status": "insufficient", "reason": "' || p_brand || '", "deep": {"x": {"y": 2}}} end' WHEN 4 THEN p_name || ' <answer_json>{bad</answer_json> {"status": "rewrite_search", "rewrite_query": "' || p_type || '"}'
  WHEN 5 THEN '{"status": "odd", "answer": "' || p_type || '"}' WHEN 6 THEN p_name || '<answer_json>{"status": "insufficient", "partial_answer": ""}</answer_json>' ELSE '{ {"x": 1' END"""


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 3 THEN 'insufficient' WHEN 4 THEN 'rewrite_search' WHEN 6 THEN 'insufficient' ELSE 'answered' END AS status,
  CASE p_partkey % 8 WHEN 0 THEN trim(p_name) WHEN 1 THEN p_type WHEN 2 THEN p_name WHEN 5 THEN p_type WHEN 7 THEN '{ {"x": 1' END AS answer_text, CASE p_partkey % 8 WHEN 6 THEN trim(p_name) END AS partial,
  CASE p_partkey % 8 WHEN 3 THEN p_brand END AS reason, CASE p_partkey % 8 WHEN 4 THEN p_type END AS rewrite_query FROM part""")
def answer_blocks(spark, d):
    rows = S.read(spark, d, "part").withColumn("raw", F.expr(_RAW))
    return W.parse_answers(rows, "raw").select("p_partkey", "status", "answer_text", "partial", "reason", "rewrite_query")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_brand END AS fact FROM part""")
def memory_blocks(spark, d):
    k, o = F.col("p_partkey") % 4, F.concat(F.lit('{"fact": "'), "p_brand", F.lit('"}'))
    raw = F.when(k == 0, o).when(k == 1, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).when(k == 2, F.concat(F.lit("I found "), o, F.lit(" in it."))).otherwise("nothing {here")
    return S.read(spark, d, "part").select("p_partkey", F.get_json_object(W.memory_object(raw), "$.fact").alias("fact"))


@query("""SELECT p_partkey, 'Type: function' || chr(10) || 'Name: ' || p_name || chr(10) || 'Docstring: ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || chr(10) || chr(10) || 'def f():' || chr(10) || '    \"\"\"' || p_type || '\"\"\"' AS text FROM part""")
def embedding_texts(spark, d):
    source = F.concat(F.lit('def f():\n    """'), "p_type", F.lit('"""'))
    return S.read(spark, d, "part").select("p_partkey", W.embedding_text(F.lit("function"), F.col("p_name"), source, F.col("p_size") % 2 == 0).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[Conversation summary so far]' || chr(10) || p_type ELSE '' END AS history, CASE WHEN p_size % 3 = 0 THEN chr(10) || '=== LONG-TERM MEMORY (from earlier in this session) ===' || chr(10) || 'Feature: ' || p_brand || chr(10)
  || 'Confidence: high  |  Exploration: partial' || chr(10) || p_type || chr(10) || '=== END LONG-TERM MEMORY ===' || chr(10) ELSE '' END || p_name AS context, p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '# Repository language coverage' || chr(10) || p_type || chr(10) ELSE '' END AS prompt FROM part""")
def prompt_parts(spark, d):
    some = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    memory = W.with_memory(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.lit("high"), F.lit("partial"), F.col("p_type"))
    return S.read(spark, d, "part").select("p_partkey", W.history_with_summary(some).alias("history"), memory.alias("context"), W.with_language_note(F.col("p_name"), some).alias("prompt"))


@query(with_("entities", """SELECT id, '  [Core]' || chr(10) || '    Type    : ' || type || chr(10) || '    Name    : ' || name || chr(10) || '    Citation: [' || file_path || ':' || start_line || '-' || end_line || ']' || chr(10) || '    Source:' || chr(10) || '      a = 1' || chr(10) || '      self.x = ' || id AS block, 1 AS refs FROM entities"""))
def entity_blocks(spark, d):
    e = D.entities(spark, d).withColumn("source", F.concat(F.lit("a = 1\nself.x = "), "id", F.lit("\n")))
    return e.select("id", W.entity_block(F.lit("Core"), "  ").alias("block"), T.self_references(F.col("source")).cast("int").alias("refs"))


@query("SELECT l_orderkey, string_agg(CASE WHEN r > 1 THEN '(continued) ' ELSE '' END || l_returnflag, ' ' ORDER BY r) AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS r FROM lineitem) GROUP BY l_orderkey")
def continued_chunks(spark, d):
    rows = S.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"))
    return W.merge_chunks(rows, ["l_orderkey"], "l_linenumber", "text")


@query("""SELECT p_partkey, 3 * n + i AS chunk_index, 5 * n AS total_chunks, substr('ab' || chr(10) || 'cdef' || chr(10) || 'g', CASE i WHEN 0 THEN 1 ELSE 4 END, CASE i WHEN 0 THEN 2 ELSE 6 END) AS text
  FROM (SELECT p_partkey, 2 AS n, unnest([0, 1]) AS i FROM part)""")
def resplit_batches(spark, d):
    items = S.read(spark, d, "part").select("p_partkey", F.lit(3).alias("chunk_index"), F.lit(5).alias("total_chunks"), F.lit("ab\ncdef\ng").alias("text"))
    return W.resplit(items, 6, "text", R.line_chunks)


@query("SELECT source, CASE WHEN n <= 3 THEN '3-4' WHEN n <= 6 THEN '4-5' ELSE '5-6' END AS short, CASE WHEN n <= 2 THEN '6-7' WHEN n <= 5 THEN '7-8' ELSE '8-10' END AS detailed FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def sentence_ranges(spark, d):
    n = S.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", W.sentence_range(F.col("n"), False).alias("short"), W.sentence_range(F.col("n"), True).alias("detailed"))


@query("SELECT p_partkey, 'query' AS intent, 'semantic_search' AS retrieval_strategy, p_name AS search_query, 0.0::DOUBLE AS confidence FROM part")
def default_plans(spark, d):
    return W.default_plan(S.read(spark, d, "part").select("p_partkey", "p_name"), "p_name").drop("p_name")


@query(with_("entities", """SELECT m.file_path, 'module ' || m.name AS source, coalesce((SELECT string_agg(e.id, ' ' ORDER BY e.start_line, e.id) FROM entities e WHERE e.file_path = m.file_path AND e.type IN ('function', 'class', 'method', 'interface')), '') AS listed FROM entities m WHERE m.type = 'module'"""))
def file_entity_map(spark, d):
    e = D.entities(spark, d).withColumn("source", F.when(F.col("type") == "module", F.concat(F.lit("module "), "name")))
    return O.file_map(e).select("file_path", "source", F.array_join(F.transform("entities", lambda x: x["id"]), " ").alias("listed"))


@query(with_("entities edges", "SELECT id, type FROM entities WHERE id IN (SELECT source_id FROM edges WHERE type = 'INHERITS')"))
def overview_entities(spark, d):
    visited = D.edges(spark, d).filter("type = 'INHERITS'").select(F.col("source_id").alias("id"))
    return O.overview_entities(D.entities(spark, d), visited).select("id", "type")


@query(with_("entities", "SELECT '[' || file_path || ':' || start_line || '-' || end_line || ']' AS raw, id AS entity_id, 'definition' AS kind FROM entities WHERE type = 'module' AND file_path IN (SELECT file_path FROM entities WHERE type = 'class')"))
def overview_report(spark, d):
    e = D.entities(spark, d)
    return O.overview_report(e, e.filter("type = 'class'").select("file_path")).select("raw", "entity_id", "kind")


@query(with_("answers", r"SELECT answer_id, trim(regexp_replace(answer, '\[([^\[\]\s:`]+\.[a-zA-Z0-9]+):(\d+)(?:-(\d+))?\]', '', 'g')) AS answer FROM answers"))
def overview_answers(spark, d):
    return D.answers(spark, d).select("answer_id", W.without_citations(F.col("answer")).alias("answer"))


@query(with_("entities edges", """+ f AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id WHERE s.file_path <> t.file_path)
  SELECT 'Repository has ' || (SELECT count(DISTINCT file_path) FROM entities) || ' files and ' || (SELECT count(*) FROM f) || ' cross-file edges. Key files (by entry score): ' || (SELECT string_agg(p, ', ' ORDER BY p) FROM (SELECT DISTINCT file_path AS p FROM entities ORDER BY 1 LIMIT 5)) AS hint"""))
def walk_hint(spark, d):
    e = D.entities(spark, d)
    n = e.agg(F.count_distinct("file_path").alias("files"))
    m = G.file_edges(e, D.edges(spark, d)).agg(F.count("*").alias("links"))
    keys = e.select("file_path").distinct().orderBy("file_path").limit(5).agg(F.array_sort(F.collect_list("file_path")).alias("keys"))
    none = F.array().cast("array<string>")
    return n.join(m, F.lit(True)).join(keys, F.lit(True)).select(O.walk_hint(F.col("files"), F.col("links"), none, F.col("keys")).alias("hint"))  # three tables of one row


@query("""SELECT n_nationkey AS repo_id, 'Repository: ' || n_name || '  |  ' || files || ' files across ' || n || ' folders' || chr(10) || chr(10) || x AS context FROM nation JOIN (
  SELECT c_nationkey, sum(files) AS files, count(*) AS n, string_agg('=== ' || CASE folder WHEN '.' THEN '(root)' ELSE folder END || ' ===' || chr(10) || summary, chr(10) || chr(10) ORDER BY folder) AS x
  FROM (SELECT c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN '.' ELSE c_mktsegment END AS folder, max(c_name) AS summary, count(*) AS files FROM customer GROUP BY ALL) GROUP BY c_nationkey) ON c_nationkey = n_nationkey""")
def summary_context(spark, d):
    folder = F.when(F.col("c_mktsegment") == "BUILDING", ".").otherwise(F.col("c_mktsegment"))
    c = S.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("repo_id"), folder.alias("folder")).agg(F.max("c_name").alias("summary"), F.count("*").alias("files"))
    return O.summary_context(c, S.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo_id"), F.col("n_name").alias("name")))


@query("SELECT n_nationkey AS repo_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_entities, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS n_edges FROM nation")
def repo_totals(spark, d):
    c = S.read(spark, d, "customer").select(F.col("c_nationkey").alias("repo_id"))
    s = S.read(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("repo_id"))
    return O.repo_totals(S.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo_id")), c, s)


@query(with_("entities edges", """+ up AS (SELECT id, id AS ancestor, 0 AS hop FROM entities UNION ALL SELECT id, parent_id, 1 FROM entities WHERE parent_id IS NOT NULL) SELECT up.id, hop, e.id AS edge_id, e.type FROM up JOIN edges e ON e.target_id = ancestor"""))
def ancestor_edges(spark, d):
    return G.ancestor_edges(D.entities(spark, d), D.edges(spark, d)).select("id", "hop", "edge_id", "type")


@query("SELECT url, (length(url) - length(replace(url, '.', '')))::INTEGER AS depth FROM pages")
def parents_first(spark, d):
    return O.parents_first(S.read(spark, d, "pages").select("url"), "url").select("url", "depth")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'n/a' END AS found FROM part")
def report_metrics(spark, d):
    text = F.concat(F.lit("| Size | "), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("none"), F.lit(" |\n| Size | 999 |"))
    return S.read(spark, d, "part").select("p_partkey", O.metric(F.substring_index(text, "\n", 1), r"Size \| (\d+)", "n/a").alias("found"))


@query("SELECT row_number() OVER (ORDER BY n, r_regionkey)::INTEGER AS row, line FROM (SELECT 0 AS n, 0 AS r_regionkey, '# Regions' AS line UNION ALL SELECT 1, 0, '' UNION ALL SELECT 2, 0, '| r_regionkey | r_name |' UNION ALL SELECT 3, 0, '|-|-|' UNION ALL SELECT 4, r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)")
def markdown_report(spark, d):
    from pyspark.sql import Window

    lines = O.markdown(S.read(spark, d, "region").select("r_regionkey", "r_name"), "Regions", ["r_regionkey"])
    return lines.select(F.row_number().over(Window.orderBy("n", "line")).alias("row"), "line")  # a report of a bounded table


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS who FROM events")
def log_round_trip(spark, d):
    e = S.read(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("who"), F.lit(None).cast("string").alias("none"))
    back = S.parse_log(S.log_lines(e, "step", ["event_id", "kind", "who", "none"]))
    at = lambda k: F.element_at(F.filter("fields", lambda f: f["k"] == k), 1)["v"]
    return back.select(at("event_id").cast("long").alias("event_id"), at("kind").alias("kind"), at("who").alias("who"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'clone' ELSE 'path' END AS kind, page_id % 4 <> 1 AS safe FROM pages")
def source_router(spark, d):
    k = F.col("page_id")
    p = S.read(spark, d, "pages")
    return p.select("page_id", T.source_kind(F.when(k % 3 == 0, " HTTPS://x.org/a ").otherwise("/home/a")).alias("kind"), T.safe_path(F.when(k % 4 == 1, "a\\..\\b").otherwise("a..b/c")).alias("safe"))


@query("SELECT type, count(*) AS n FROM (SELECT 'all' AS type FROM events UNION ALL SELECT 'some' FROM events WHERE event_type IN ('view', 'error')) GROUP BY 1")
def optional_filters(spark, d):
    e = S.read(spark, d, "events")
    count = lambda values, name: S.where_any(e, "event_type", values).agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    return count([], "all").unionByName(count(["view", "error"], "some"))


@query(with_("entities edges", """SELECT file_path, depth, row_number() OVER (ORDER BY depth, file_path)::INTEGER AS at FROM (SELECT file_path, min(depth) AS depth FROM (
  SELECT 'src/n3.py' AS file_path, 0 AS depth UNION ALL SELECT t.file_path, 1 FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id WHERE s.file_path = 'src/n3.py' AND t.file_path <> 'src/n3.py') GROUP BY 1)"""))
def graph_from_root(spark, d):
    from pyspark.sql import Window

    e = D.entities(spark, d)
    nodes = walk.file_nodes(e, e.filter("false").select("id", F.lit(0).alias("score")))
    seen, _ = walk.graph_view(nodes, walk.file_links(G.file_edges(e, D.edges(spark, d))), "src/n3.py", 1)
    return seen.select("file_path", "depth", F.row_number().over(Window.orderBy("depth", "file_path")).alias("at"))  # files of one repository


@query("SELECT p_partkey, intent, strategy AS retrieval_strategy, CASE WHEN strategy <> 'repository_walk' THEN p_name END AS search_query, confidence FROM (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'query' ELSE 'repository_overview' END AS intent, CASE p_partkey % 3 WHEN 2 THEN 'repository_walk' ELSE 'semantic_search' END AS strategy, CASE p_partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence FROM part)")
def plan_parse(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, 'so: {"intent": "feature", "retrieval_strategy": "semantic_search", "confidence": 0.9} yes').when(k == 1, "no object").otherwise('{"intent": "repository_walk", "retrieval_strategy": "repository_walk"}')
    p = S.read(spark, d, "part").select("p_partkey", "p_name", raw.alias("raw"))
    return walk.parse_plan(p, "raw", "p_name").select("p_partkey", "intent", "retrieval_strategy", "search_query", "confidence")


_PATHS = "paths AS (SELECT doc_id, coalesce(source, '') AS repo, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'd' || (doc_id % 7) || '/' || CASE WHEN doc_id % 3 = 0 THEN 's' || (doc_id % 2) || '/' ELSE '' END END || 'f' || doc_id || '.py' AS file_path, coalesce(lang, '') || n_chars AS text FROM documents)"


def _paths(spark, d):
    k = F.col("doc_id")
    inner = F.when(k % 3 == 0, F.concat(F.lit("s"), (k % 2).cast("string"), F.lit("/"))).otherwise("")
    path = F.concat(F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"), inner)), F.lit("f"), k.cast("string"), F.lit(".py"))
    return S.read(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("repo_id"), path.alias("file_path"), F.concat(F.coalesce("lang", F.lit("")), F.col("n_chars").cast("string")).alias("text"))


@query("WITH " + _PATHS + """, parts AS (SELECT DISTINCT repo, string_split(file_path, '/') AS p FROM paths),
  pre AS (SELECT repo, p[1:i] AS key, max(len(p)) AS n FROM (SELECT repo, p, unnest(range(1, len(p) + 1)) AS i FROM parts) GROUP BY ALL),
  flags AS (SELECT repo, key, key[-1] AS name, n > len(key) AS open, key[-1] = max(key[-1]) OVER (PARTITION BY repo, key[1:len(key) - 1]) AS last FROM pre),
  bars AS (SELECT a.repo, a.key, string_agg(CASE WHEN f.last THEN '    ' ELSE '│   ' END, '' ORDER BY len(f.key)) AS bar FROM (SELECT repo, key, unnest(range(1, len(key))) AS i FROM flags) a JOIN flags f ON f.repo = a.repo AND f.key = a.key[1:a.i] GROUP BY ALL),
  lines AS (SELECT DISTINCT repo, []::VARCHAR[] AS key, '.' AS line FROM paths UNION ALL
    SELECT f.repo, f.key, coalesce(bar, '') || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN open THEN '/' ELSE '' END FROM flags f LEFT JOIN bars b ON b.repo = f.repo AND b.key = f.key)
  SELECT repo AS repo_id, row_number() OVER (PARTITION BY repo ORDER BY key) - 1 AS n, line FROM lines""")
def directory_tree(spark, d):
    return trees.directory_tree(_paths(spark, d))


@query("WITH " + _PATHS + """, f AS (SELECT repo, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, string_agg(text, '+' ORDER BY file_path) AS t FROM paths GROUP BY ALL)
  SELECT repo AS repo_id, md5(string_agg(t, '|' ORDER BY folder)) AS digest, count(*) AS folders FROM f GROUP BY repo""")
def repo_summaries(spark, d):
    """Files to folders to repositories by a tree of at most 8 texts a node; joining is the same however it is nested."""
    plus, bar = lambda x: F.array_join(x, "+"), lambda x: F.array_join(x, "|")
    files = _paths(spark, d).withColumn("folder", T.folder(F.col("file_path")))
    folders = S.cut(trees.reduced(files, ["repo_id", "folder"], "file_path", "text", plus, 8, plus))
    repos = trees.reduced(folders, ["repo_id"], "folder", "text", bar, 8, bar)
    return repos.join(folders.groupBy("repo_id").agg(F.count("*").alias("folders")), "repo_id").select("repo_id", F.md5("text").alias("digest"), "folders")


@query("""WITH p AS (SELECT doc_id, len(regexp_extract_all(text, '\\n')) + 1 AS n FROM documents)
  SELECT doc_id, 'function' AS type, 1::BIGINT AS n, 2::INT AS first_line FROM p UNION ALL SELECT doc_id, 'module', 1, 1 FROM p UNION ALL SELECT doc_id, 'class', 1, (n + 4)::INT FROM p UNION ALL SELECT doc_id, 'method', 1, (n + 5)::INT FROM p""")
def facts_from_sql(spark, d):
    """Sources around every document's text, read by a table function in SQL: a text in a template hides nothing after it."""
    TF.register(spark)
    body = F.regexp_replace(F.regexp_replace("text", r"[`\\]", "'"), r"\$\{", "{")
    text = F.concat(F.lit("// a text\nfunction f() {\n  return `"), body, F.lit("`;\n}\nclass C {\n  m(): string { return `${f()}`; }\n}\n"))
    S.read(spark, d, "documents").select("doc_id", text.alias("content")).createOrReplaceTempView("_sources")
    found = spark.sql("SELECT s.doc_id, f.type, f.line FROM _sources s, LATERAL source_facts('r', concat('d', s.doc_id, '.ts'), s.content) f WHERE f.kind = 'entity'")
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
