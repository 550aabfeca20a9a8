"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines (blank ones skipped) is hashed; a window that
occurs again anywhere later, in the order of id and position, is repeated there. The
lines that such later occurrences cover are merged per document and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, NOT_WS, WS, table


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _full(lines: Column) -> Column:
    """Indices of lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_WS), i)), lambda i: i.isNotNull())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with text_col deduplicated, and n_lines and n_removed (lines that are not blank).

    Lines are compared without white space at their ends. The first occurrence of a
    window is the one with the least (id, text hash, position); null ids come first.
    Rows equal in id and text are one document here: they stay equal to each other and
    do not repeat one another. Documents with fewer than ``window`` lines have no
    window and stay; a document whose lines all go keeps its row with an empty text;
    null texts stay null with 0 lines; blank lines stay; very long texts are taken whole,
    and only hashes of their windows are shuffled; an empty table stays empty.
    Columns named n_lines or n_removed are replaced; names that begin with ``_d_`` are
    the operator's own.
    """
    df = docs.withColumns({
        "_d_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
        "_d_th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null"))),
    })
    trim = rf"^{WS}+|{WS}+$"
    some = df.select("_d_id", "_d_th", F.filter(_lines(F.col(text_col)), lambda x: x.rlike(NOT_WS)).alias("_d_l"))
    some = some.filter(F.size("_d_l") >= window)
    # 96 bits, so that different windows of a large corpus do not meet.
    some = some.withColumn("_d_h", F.transform("_d_l", lambda x: F.struct(
        F.xxhash64(F.regexp_replace(x, trim, "")).alias("a"), F.hash(F.regexp_replace(x, trim, "")).alias("b"),
    )))
    at = lambda j, k, n: F.get("_d_h", j + k)[n]
    hashed = F.transform(F.sequence(F.lit(0), F.size("_d_h") - window), lambda j: F.struct(
        F.xxhash64(*[at(j, k, "a") for k in range(window)]).alias("wa"),
        F.hash(*[at(j, k, n) for k in range(window) for n in "ba"]).alias("wb"),
        j.alias("j"),
    ))
    seen = some.select("_d_id", "_d_th", F.explode(hashed).alias("w")).select("_d_id", "_d_th", "w.wa", "w.wb", "w.j").distinct()
    place = F.struct("_d_id", "_d_th", "j")
    repeated = seen.groupBy("wa", "wb").agg(F.count("*").alias("_d_n"), F.min(place).alias("_d_first")).filter("_d_n > 1")
    later = seen.join(repeated, ["wa", "wb"]).filter(place != F.col("_d_first"))
    per_doc = later.groupBy("_d_id", "_d_th").agg(F.collect_set("j").alias("_d_j"))

    out = df.join(per_doc, ["_d_id", "_d_th"], "left").withColumn("_d_lines", _lines(F.col(text_col)))
    out = out.withColumn("_d_full", _full(F.col("_d_lines")))
    covered = F.array_distinct(F.flatten(F.transform("_d_j", lambda j: F.transform(
        F.sequence(j, j + (window - 1)), lambda k: F.get("_d_full", k)
    ))))
    out = out.withColumn("_d_gone", covered)
    left = F.array_except(F.sequence(F.lit(0), F.size("_d_lines") - 1), "_d_gone")
    text = F.when(F.col("_d_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_d_lines", i)), "\n")
    )
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.withColumns({
        text_col: text,
        "n_lines": F.size("_d_full").cast("long"),
        "n_removed": F.coalesce(F.size("_d_gone"), F.lit(0)).cast("long"),
    }).select(*keep, "n_lines", "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


_TRIM = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP9_SQL = rf"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut
), whole AS (
  SELECT doc_id, i, {_TRIM.replace("x,", "line,")} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM placed WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), wins AS (
  SELECT doc_id, j, i, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM whole WINDOW w AS (PARTITION BY doc_id ORDER BY j)
), late AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, j) AS r FROM wins WHERE win IS NOT NULL) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM late
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM whole GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
