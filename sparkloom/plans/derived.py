"""Code-graph tables derived from the fixed tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Nations are modules, suppliers classes and customers methods of their files."""
    file = lambda c: F.concat(F.lit("src/n"), c.cast("string"), F.lit(".py"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = read(spark, d, "nation").select(
        key("n", "n_nationkey").alias("id"), F.lit("module").alias("type"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        file(F.col("n_nationkey")).alias("file_path"), F.lit(1).cast("long").alias("start_line"), F.lit(400).cast("long").alias("end_line"),
    )
    s = read(spark, d, "supplier").select(
        key("s", "s_suppkey").alias("id"), F.lit("class").alias("type"), F.col("s_name").alias("name"), key("n", "s_nationkey").alias("parent_id"),
        file(F.col("s_nationkey")).alias("file_path"), (F.col("s_suppkey") % 200 + 1).alias("start_line"), (F.col("s_suppkey") % 200 + 41).alias("end_line"),
    )
    c = read(spark, d, "customer").select(
        key("c", "c_custkey").alias("id"), F.lit("method").alias("type"), F.col("c_name").alias("name"), key("n", "c_nationkey").alias("parent_id"),
        file(F.col("c_nationkey")).alias("file_path"), (F.col("c_custkey") % 360 + 1).alias("start_line"), (F.col("c_custkey") % 360 + 1 + F.col("c_custkey") % 30).alias("end_line"),
    )
    return n.unionByName(s).unionByName(c)


KINDS = {"error": "CALLS", "click": "IMPORTS", "purchase": "INHERITS", "signup": "INSTANTIATES", "view": "IMPLEMENTS"}


def edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge of every event, from its user to one of all customers."""
    e = read(spark, d, "events")
    n = max(1, read(spark, d, "customer").count())  # from the files' footers
    kind = F.lit("CONTAINS")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    to = (F.col("user_id") * 7 + F.col("event_id")) % n
    e = e.select(F.col("event_id").alias("id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("source_id"), F.concat(F.lit("c"), to.cast("string")).alias("target_id"), kind.alias("type"))
    return e.filter("source_id <> target_id")


def contains(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).filter("parent_id is not null")
    return e.select(F.xxhash64("id").alias("id"), F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("type"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Texts that cite files, some in backticks, some with placeholders."""
    a = F.col("n_chars") % 50 + 1
    tag = lambda x, y: F.concat(F.lit("src/n"), (F.col("doc_id") % 31).cast("string"), F.lit(".py:"), x.cast("string"), F.lit("-"), y.cast("string"))
    text = F.concat(
        F.lit("see ["), tag(a, a + F.col("doc_id") % 7), F.lit("] and [`"), tag(a + 100, a + 120), F.lit("`] or [src/x.py:start-end] then ["),
        tag(a, a + F.col("doc_id") % 7), F.lit("]."),
    )
    return read(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), text.alias("answer"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Answers that say of a symbol that it calls what a citation points at: the event's user, nobody, the target itself or another user."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    e = edges(spark, d).select("id", "source_id", F.substring("target_id", 2, 20).cast("long").alias("k")).join(c, "k")
    a = F.col("k") % 360 + 1
    who = F.when(F.col("id") % 4 == 1, "it").when(F.col("id") % 4 == 2, F.concat(F.lit("c"), F.col("k").cast("string")))
    who = who.when(F.col("id") % 4 == 3, F.concat(F.col("source_id"), F.lit("1"))).otherwise(F.col("source_id"))
    text = F.concat(who, F.lit(" calls [src/n"), F.col("c_nationkey").cast("string"), F.lit(".py:"), a.cast("string"), F.lit("-"), (a + F.col("k") % 30).cast("string"), F.lit("]."))
    return e.select(F.col("id").alias("answer_id"), text.alias("answer"))


SQL = {
    "entities": """entities AS (
  SELECT 'n' || n_nationkey AS id, 'module' AS type, n_name AS name, NULL::VARCHAR AS parent_id, 'src/n' || n_nationkey || '.py' AS file_path, 1::BIGINT AS start_line, 400::BIGINT AS end_line FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'class', s_name, 'n' || s_nationkey, 'src/n' || s_nationkey || '.py', s_suppkey % 200 + 1, s_suppkey % 200 + 41 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'method', c_name, 'n' || c_nationkey, 'src/n' || c_nationkey || '.py', c_custkey % 360 + 1, c_custkey % 360 + 1 + c_custkey % 30 FROM customer)""",
    "edges": """edges AS (
  SELECT * FROM (SELECT event_id AS id, 'c' || user_id AS source_id, 'c' || ((user_id * 7 + event_id) % greatest(1, (SELECT count(*) FROM customer))) AS target_id,
    CASE event_type WHEN 'error' THEN 'CALLS' WHEN 'click' THEN 'IMPORTS' WHEN 'purchase' THEN 'INHERITS' WHEN 'signup' THEN 'INSTANTIATES' WHEN 'view' THEN 'IMPLEMENTS' ELSE 'CONTAINS' END AS type
  FROM events) WHERE source_id <> target_id)""",
    "answers": """answers AS (
  SELECT doc_id AS answer_id, 'see [src/n' || (doc_id % 31) || '.py:' || (n_chars % 50 + 1) || '-' || (n_chars % 50 + 1 + doc_id % 7) || '] and [`src/n' || (doc_id % 31) || '.py:' || (n_chars % 50 + 101) || '-' || (n_chars % 50 + 121)
    || '`] or [src/x.py:start-end] then [src/n' || (doc_id % 31) || '.py:' || (n_chars % 50 + 1) || '-' || (n_chars % 50 + 1 + doc_id % 7) || '].' AS answer FROM documents)""",
    "claims": """claims AS (
  SELECT e.id AS answer_id, CASE e.id % 4 WHEN 1 THEN 'it' WHEN 2 THEN 'c' || k WHEN 3 THEN source_id || '1' ELSE source_id END AS symbol, 'src/n' || c_nationkey || '.py' AS file_path, k % 360 + 1 AS start_line, k % 360 + 1 + k % 30 AS end_line
  FROM (SELECT *, substr(target_id, 2)::BIGINT AS k FROM edges) e JOIN customer ON c_custkey = k)""",
    "links": "links AS (SELECT id, source_id, target_id, type FROM edges UNION ALL SELECT NULL, parent_id, id, 'CONTAINS' FROM entities WHERE parent_id IS NOT NULL)",
    "cites": r"""cites AS (
  SELECT answer_id, raw, pos, regexp_extract(raw, '\[([^\[\]\s:`]+):', 1) AS file_path, regexp_extract(raw, ':(\d+)', 1)::BIGINT AS start_line, regexp_extract(raw, '-(\d+)\]', 1)::BIGINT AS end_line
  FROM (SELECT answer_id, raw, instr(n, raw) AS pos FROM (
    SELECT answer_id, n, unnest(list_distinct(regexp_extract_all(n, '\[[^\[\]\s:`]+\.[a-zA-Z0-9]+:\d+(?:-\d+)?\]'))) AS raw
    FROM (SELECT answer_id, regexp_replace(answer, '\[`([^\[\]\s:`]+\.[a-zA-Z0-9]+:\d+(?:-\d+)?)`\]', '[\1]', 'g') AS n FROM answers))))""",
}


def with_(names: str, sql: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(SQL[n] for n in names.split()) + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().lstrip("+")
