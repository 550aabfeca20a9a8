"""Filter interaction audit: what each of several filters removes, in every order of them.

What a document fails is a word of letters, one a filter. Duplicates are found by
sorting: texts are dealt out in ranges of (fingerprint, id) and sorted by fingerprint,
full text and id, and each row is compared with the one before it. A run of equal texts
that the boundary of two ranges cuts (a large group of copies is cut many times) is
mended from the fingerprints at the ends of the ranges. The words are added up to
counters per part, at most 2^n a part for n filters, and all orders follow from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words

#: Runs that boundaries cut are two a range at most; more of them than this are joined by a shuffle.
MAX_RUNS = 200_000
#: Stands behind every id.
_LAST_ID = 2**63 - 1


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, text, id), with ``least``, the id that their run of equal texts begins with, and ``range``, the task's number; without the text."""
    at = TaskContext.get().partitionId()
    fp_before = texts_before = place_before = least = None
    for b in batches:
        texts, out = b.column("text"), []
        for i, (fp, id_) in enumerate(zip(b.column("fp").to_pylist(), b.column("id").to_pylist(), strict=True)):
            # Texts are looked at only where fingerprints agree.
            if fp != fp_before or texts[i].as_py() != texts_before[place_before].as_py():
                least = id_
            out.append(least)
            fp_before, texts_before, place_before = fp, texts, i
        rest = b.drop_columns(["text"])
        yield rest.append_column("least", pa.array(out, pa.int64())).append_column("range", pa.array([at] * len(out), pa.int32()))


def with_first(docs: DataFrame, id_col: str, text_col: str, made: dict[str, Column]) -> DataFrame:
    """For every row: its id, the columns ``made`` of it, and ``first``, the least id of all rows with an identical text.

    Texts move once and are not kept; null ids are behind all others, null texts empty.
    """
    fp, text = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"_a_fp": fp, "_a_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)), "_a_text": text})
    # The id is part of the range, so that a group of copies of any size is dealt out.
    rows = rows.repartitionByRange("_a_fp", "_a_id").sortWithinPartitions("_a_fp", "_a_text", "_a_id")
    rows = rows.select(F.col("_a_fp").alias("fp"), F.sha2("_a_text", 256).alias("digest"), F.col("_a_id").alias("id"), F.col("_a_text").alias("text"), *[c.alias(n) for n, c in made.items()])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    marked = stored(rows.mapInArrow(_compared, f"{kept}, least long, range int"), "sorted_texts")

    ends = marked.groupBy("range").agg(F.array_distinct(F.array(F.min("fp"), F.max("fp"))).alias("fp")).select(F.explode("fp").alias("fp"))
    cut = ends.groupBy("fp").count().filter("count > 1").select("fp")  # as many as there are ranges at most
    runs = stored(marked.join(F.broadcast(cut), "fp", "left_semi").groupBy("fp", "digest").agg(F.min("least").alias("over")), "cut_runs")
    few = runs.count() <= MAX_RUNS
    out = marked.join(F.broadcast(runs) if few else runs, ["fp", "digest"], "left")
    return out.select(F.nullif("id", F.lit(_LAST_ID)).alias("id"), F.least("least", F.coalesce("over", "least")).alias("first"), *made)


def failed(filters: dict[str, Column]) -> Column:
    """The letters of the filters that a row fails, in the order of ``filters``."""
    return F.concat(*[F.when(c, F.lit(n)).otherwise("") for n, c in filters.items()])


def audit(rows: DataFrame, letters: str, part: str, fails: str, flags: dict[str, Column]) -> DataFrame:
    """What filters remove in every order, from the letters each row fails: one row per part, filter_order and step.

    Counts within the part: kept (left after this step), removed (here), redundant (failing
    this step's filter, removed earlier), unique_fails (failing this filter only), one
    column for each of ``flags`` (removed here, and the flag is true), shapley (removed by
    this filter, summed over all orders). Parts without a row are not there; those whose
    rows fail nothing have zeros. Only the counters move.
    """
    flags = {f"_f{i}": (n, c) for i, (n, c) in enumerate(flags.items())}
    counters = rows.groupBy(F.col(part).alias("part"), F.col(fails).alias("_mask")).agg(
        F.count("*").alias("_n"), *[F.count(F.when(c, 1)).alias(k) for k, (_, c) in flags.items()]
    )
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(letters))), " ")
    steps = counters.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("_fails", F.expr("instr(_mask, substring(filter_order, step, 1)) > 0"))
    steps = steps.withColumn("_gone", F.expr("length(translate(_mask, left(filter_order, step - 1), '')) < length(_mask)"))
    total = lambda n, when: F.sum(F.when(when, F.col(n)).otherwise(0))
    fails_, gone = F.col("_fails"), F.col("_gone")
    return steps.groupBy("part", "filter_order", "step").agg(
        total("_n", ~fails_ & ~gone).alias("kept"),
        total("_n", fails_ & ~gone).alias("removed"),
        total("_n", fails_ & gone).alias("redundant"),
        total("_n", fails_ & (F.length("_mask") == 1)).alias("unique_fails"),
        *[total(k, fails_ & ~gone).alias(n) for k, (n, _) in flags.items()],
        # Of all orders, a row that fails k filters leaves by each of them in one of k.
        F.sum(F.when(fails_, F.expr(f"_n * ({factorial(len(letters))} div length(_mask))")).otherwise(0)).alias("shapley"),
    )


#: The filters that look at one document only, by letter; texts are not null where these are worked out.
def own_filters(text: Column) -> dict[str, Column]:
    w = words(text)
    return {
        "A": F.size(w) < 100,
        "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of five filters over whole texts: few words, repeated words, capitals, symbols, duplicates.

    ``labels`` (doc_id, quality, toxic) may cover some documents; several rows of one id
    count as one that has the marks of all. Null texts are empty texts, and equal to
    those; a null part is the empty string. A document fails E if a row with a smaller id
    has its text, kept or not; rows with a null id have no label, never fail E and are no
    one's original; rows equal in id and text are no duplicates of each other. Very long
    texts are taken whole; columns besides those named are not looked at; an empty table
    gives no rows.
    """
    made = {"part": F.coalesce(F.col(part_col), F.lit("")), "own": failed(own_filters(F.col("_a_text")))}
    rows = with_first(docs.select(id_col, text_col, part_col), id_col, text_col, made)
    rows = rows.withColumn("fails", F.concat("own", F.when(F.col("id") > F.col("first"), "E").otherwise("")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(rows.join(marks, "id", "left"), "ABCDE", "part", "fails", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), masks AS (
  SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > f.first THEN 'E' ELSE '' END AS mask
  FROM docs d JOIN firsts f ON d.text = f.text LEFT JOIN marks m ON d.doc_id = m.doc_id
), counters AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS f, contains(mask, substr(filter_order, step, 1)) AS fails,
    regexp_matches(mask, '[' || substr(filter_order, 1, step - 1) || '0]') AS gone
  FROM counters c, orders, (SELECT unnest(range(1, 6))::INT AS step)
), sums AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL
), shares AS (SELECT part, f, sum(removed)::BIGINT AS shapley FROM sums GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM sums JOIN shares USING (part, f)
"""
