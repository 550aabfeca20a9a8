"""Queries over jobs, conversations and routing, and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import walk
from ..sources import tables as S
from . import derived as D
from .derived import with_
from .registry import query

#: Events as those of jobs: what a user does on a day is a job.
_JOBS = """jobs AS (SELECT user_id || '-' || (floor(epoch(ts) / 86400)::BIGINT) AS job, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'pending' END AS status FROM events)"""


def _jobs(spark, d):
    e = S.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), slot.cast("string")).alias("job"), F.col("event_id").alias("seq"), kind.alias("status"))


#: One step an event of a job: the state after it, and whether the event was legal.
_STEPS = _JOBS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS r FROM jobs),
  steps AS (SELECT job, seq, r, CASE WHEN status = 'pending' THEN 'pending' END AS state, status = 'pending' AS legal FROM numbered WHERE r = 1 UNION ALL
    SELECT n.job, n.seq, n.r, CASE WHEN ok THEN n.status ELSE n.state END, ok FROM (SELECT m.*, s.state, coalesce(CASE m.status WHEN 'pending' THEN s.state IS NULL WHEN 'running' THEN s.state IN ('pending', 'running')
      WHEN 'done' THEN s.state = 'running' WHEN 'failed' THEN s.state IN ('pending', 'running') END, false) AS ok FROM steps s JOIN numbered m ON m.job = s.job AND m.r = s.r + 1) n)"""


@query("WITH RECURSIVE " + _STEPS + " SELECT job, seq, legal FROM steps")
def job_transitions(spark, d):
    return J.transitions(_jobs(spark, d), "job", "status", ["seq"]).select("job", "seq", "legal")


@query("WITH RECURSIVE " + _STEPS + " SELECT job, arg_max(state, r) AS status, count(*) FILTER (NOT legal) AS n_illegal FROM steps GROUP BY job")
def job_last_states(spark, d):
    return J.job_states(_jobs(spark, d), "job", "status", ["seq"])


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN 'not_found' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_custkey <> o_custkey + o_orderkey % 2 THEN 'forbidden' ELSE CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END END AS answer,
  CASE WHEN answer = 'done' THEN o_orderdate::VARCHAR END AS result, CASE WHEN answer = 'running' THEN o_orderpriority END AS progress FROM orders""")
def job_answers(spark, d):
    o, k = S.read(spark, d, "orders"), F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    jobs = o.filter(k % 7 != 0).select(k.alias("job_id"), F.lit("r").alias("repo_id"), F.when(k % 3 != 0, F.col("o_custkey")).alias("user_id"), state.alias("status"), F.col("o_orderdate").cast("string").alias("result"), F.col("o_orderpriority").alias("progress"), F.lit(None).cast("string").alias("error"))
    asked = o.select(k.alias("job_id"), F.lit("r").alias("repo_id"), F.when(k % 5 != 0, F.col("o_custkey") + k % 2).alias("asker"))
    return J.job_answers(asked, jobs).select("job_id", "answer", "result", "progress")


_SAVED = """had AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE conv_id % 3 = 0 AND turn < 2 GROUP BY conv_id), more AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn < 2)),
  saved AS (SELECT conv_id, turn AS turn_index, role, text FROM conversations WHERE conv_id % 3 = 0 AND turn < 2 UNION ALL SELECT m.conv_id, (CASE WHEN h.conv_id IS NULL THEN 0 ELSE coalesce(h.m, 0) + 1 END + p)::INT, role, text FROM more m LEFT JOIN had h ON h.conv_id = m.conv_id)"""


def _saved(spark, d):
    """Every third conversation is there with its first two turns; all other turns come in."""
    t = S.read(spark, d, "conversations")
    there = (F.col("conv_id") % 3 == 0) & (F.col("turn") < 2)
    zero = F.lit(0).cast("timestamp")
    old = t.filter(there).select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("turn_index"), "role", F.col("text").alias("content"), zero.alias("created_at"))
    convs = old.select(F.col("conversation_id").alias("id")).distinct().select("id", (F.col("id") % 5).alias("user_id"), F.lit("r").alias("repo_id"), F.lit(0).alias("summarized_through_turn"), zero.alias("created_at"), zero.alias("updated_at"))
    new = t.filter(~there).select(F.col("conv_id").alias("conversation_id"), (F.col("conv_id") % 5).alias("user_id"), F.lit("r").alias("repo_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.col("conv_id") % 97 + F.col("turn")).alias("at"))
    return J.saved_turns(new, convs, old)


@query("WITH " + _SAVED + " SELECT conv_id, turn_index, role, md5(text) AS digest FROM saved")
def saved_turns(spark, d):
    _, turns = _saved(spark, d)
    return turns.select(F.col("conversation_id").alias("conv_id"), "turn_index", "role", F.md5("content").alias("digest"))


@query("WITH " + _SAVED + """, convs AS (SELECT conv_id, coalesce(max(CASE WHEN conv_id % 3 = 0 AND turn < 2 THEN NULL ELSE conv_id % 97 + turn END), 0) AS upd FROM conversations WHERE conv_id % 5 = 2 GROUP BY conv_id ORDER BY upd DESC, conv_id LIMIT 20)
  SELECT c.conv_id, count(*) AS n, md5(string_agg(role || ' ' || md5(text), '|' ORDER BY turn_index)) AS digest FROM convs c JOIN saved s USING (conv_id) GROUP BY c.conv_id""")
def conversations_with_turns(spark, d):
    convs, turns = _saved(spark, d)
    out = J.listed(convs, turns, 2, "r", 50)
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(" "), F.md5(t["content"])))
    return out.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n"), F.md5(F.array_join(line, "|")).alias("digest"))


@query("""WITH m AS (SELECT p_partkey AS model, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM part WHERE p_brand = 'Brand#11' OR p_partkey < 40), tried AS (SELECT DISTINCT l_orderkey AS task, l_partkey AS model FROM lineitem)
  SELECT task, arg_min(model, r) AS model_id FROM (SELECT t.task, m.model, m.r FROM (SELECT DISTINCT task FROM tried) t, m WHERE (t.task, m.model) NOT IN (SELECT (task, model) FROM tried)) GROUP BY task""")
def next_models(spark, d):
    p = S.read(spark, d, "part").filter("p_brand = 'Brand#11' or p_partkey < 40").select(F.col("p_partkey").alias("model_id"), "p_size")
    tried = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("model_id"))
    return J.next_models(p, tried, "task", ["p_size", "model_id"])


@query("""WITH r AS (SELECT l_orderkey AS scenario, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank, 'e' || l_partkey AS id FROM lineitem), w AS (SELECT o_orderkey AS scenario, 'e' || (o_orderkey % 9 + 1) AS preferred, 'e' || (o_orderkey % 7 + 1) AS over FROM orders),
  x AS (SELECT w.*, min(CASE WHEN contains(id, preferred) THEN rank - 1 END) AS p, min(CASE WHEN contains(id, over) THEN rank - 1 END) AS o FROM w LEFT JOIN r USING (scenario) GROUP BY ALL)
  SELECT scenario, CASE WHEN p IS NULL THEN 'absent' WHEN o IS NULL THEN 'alone' WHEN p < o THEN 'passed' ELSE 'failed' END AS check FROM x""")
def preferred_over(spark, d):
    from ..operators.ordered import running

    r = running(S.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], {})
    r = r.select(F.col("l_orderkey").alias("scenario"), (F.col("pos") + 1).alias("rank"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("id"))
    k = F.col("o_orderkey")
    part = lambda n: F.concat(F.lit("e"), (k % n + 1).cast("string"))
    return J.preferred_over(r, S.read(spark, d, "orders").select(k.alias("scenario"), part(9).alias("preferred"), part(7).alias("over"))).select("scenario", "check")


@query(with_("entities", """SELECT c_custkey AS k, arg_min(e.id, (e.end_line - e.start_line) * 10000000 - e.start_line * 1000 + 0) AS id FROM customer LEFT JOIN (SELECT * FROM entities WHERE type = 'class') e ON e.file_path = 'src/n' || c_nationkey || '.py' AND c_custkey % 360 + 1 BETWEEN e.start_line AND e.end_line
  WHERE NOT EXISTS (SELECT 1 FROM entities f JOIN entities g ON f.file_path = g.file_path AND f.type = 'class' AND g.type = 'class' AND f.id < g.id AND f.start_line = g.start_line WHERE f.file_path = 'src/n' || c_nationkey || '.py' AND c_custkey % 360 + 1 BETWEEN f.start_line AND f.end_line) GROUP BY c_custkey"""))
def declaration_at(spark, d):
    """Lines with the class around them; those where two classes begin at one line are left to the tests."""
    e = D.entities(spark, d).filter("type = 'class'")
    twice = e.groupBy("file_path", "start_line", "end_line").agg(F.count("*").alias("n")).filter("n > 1")
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"), F.lit(".py")).alias("file_path"), (F.col("c_custkey") % 360 + 1).alias("line"))
    c = c.alias("c").join(twice.alias("t"), (F.col("c.file_path") == F.col("t.file_path")) & F.col("c.line").between(F.col("t.start_line"), F.col("t.end_line")), "left_anti")
    return J.declaration_at(e, c).select("k", "id")


@query(with_("entities", """SELECT file_path, 0 AS depth, count(*) FILTER (WHERE type <> 'module') AS children, file_path IN ('src/n3.py', 'src/n5.py') AS is_root FROM entities GROUP BY file_path"""))
def full_graph(spark, d):
    e = D.entities(spark, d)
    entries = e.filter("id in ('n3', 'n5')").select("id", F.lit(10).alias("score"))
    links = e.limit(0).select(F.lit(0).alias("id"), F.col("id").alias("source_id"), F.col("id").alias("target_id"), "type")
    seen, _ = walk.graph_view(walk.file_nodes(e, entries), links, None)
    return seen.select("file_path", "depth", "children", "is_root")
