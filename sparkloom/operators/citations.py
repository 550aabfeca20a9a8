"""Citations in answers: parse, classify, correct, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CITATION, basename, last_dotted, normalise_citations
from ..sources.tables import cut
from . import spans
from .ordered import around


def parse(answers: DataFrame) -> DataFrame:
    """(answer_id, raw, pos, file_path, start_line, end_line, symbol_text): one row per distinct tag.

    The first occurrence gives the position and the 60 characters before it, which are
    cut from the answer as it was written, at the offset in the normalised text.
    """
    text = normalise_citations(F.col("answer"))
    rows = answers.withColumn("_n", text).withColumn("_all", F.array_distinct(F.regexp_extract_all("_n", F.lit(CITATION), F.lit(0))))
    rows = rows.select("answer_id", "answer", "_n", F.posexplode("_all").alias("ord", "raw"))
    rows = rows.withColumn("pos", F.instr("_n", F.col("raw")))
    start = F.regexp_extract("raw", CITATION, 2).cast("int")
    end = F.regexp_extract("raw", CITATION, 3)
    begin = F.greatest(F.lit(1), F.col("pos") - 60)
    return rows.select(
        "answer_id", "raw", "ord", "pos", F.regexp_extract("raw", CITATION, 1).alias("file_path"), start.alias("start_line"),
        F.when(end == "", start).otherwise(end.try_cast("int")).alias("end_line"), F.substring("answer", begin, F.col("pos") - begin).alias("before"),
    )


def overlapping(citations: DataFrame, entities: DataFrame) -> DataFrame:
    """Each citation with the smallest entity of its file that its lines overlap; ties to the lesser id.

    Each range of lines is looked up once, in blocks of lines that have their least
    entity, so no citation meets all entities of a part of its file.
    """
    size = F.col("end_line").cast("long") - F.col("start_line").cast("long")
    best = spans.least_met(citations, entities.withColumn("_m", F.struct(size.alias("size"), F.col("id").alias("entity_id"))), ["file_path"], "_m")
    best = best.select("file_path", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), F.col("_m.entity_id").alias("entity_id"))
    c = citations.withColumns({"_a": F.col("start_line").cast("long"), "_b": F.col("end_line").cast("long")})
    return c.join(best, ["file_path", "_a", "_b"]).select(*citations.columns, "entity_id")


def nearest(citations: DataFrame, entities: DataFrame) -> DataFrame:
    """Each citation with the entity of its file whose first or last line is nearest to its first line; ties to the lesser id.

    The neighbours on either side, by ordered passes over ranges of a file's lines: no
    citation meets all entities of its file, and no task holds a file.
    """
    line = entities.select("file_path", F.col("id").alias("entity_id"), F.explode(F.array("start_line", "end_line")).alias("line"))
    line = line.groupBy("file_path", F.col("line").cast("long").alias("line")).agg(F.min("entity_id").alias("entity_id"))
    none = F.lit(None)
    asked = citations.select("file_path", F.col("start_line").cast("long").alias("line"), none.cast(dict(line.dtypes)["entity_id"]).alias("entity_id"), "answer_id", "raw")
    points = line.withColumns({"answer_id": none.cast(dict(citations.dtypes)["answer_id"]), "raw": none.cast("string")})
    here = F.when(F.col("entity_id").isNotNull(), F.struct("line", "entity_id"))
    met = around(asked.unionByName(points), ["file_path"], "line", here).withColumnsRenamed({"before": "_b", "after": "_a"}).filter("raw is not null")
    near = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(f"{x}.line") - F.col("line")).alias("d"), F.col(f"{x}.entity_id").alias("id")))
    met = met.select("answer_id", "raw", F.least(near("_b"), near("_a")).alias("_m")).filter("_m is not null")
    return citations.join(met.select("answer_id", "raw", F.col("_m.id").alias("entity_id"), F.col("_m.d").alias("distance")), ["answer_id", "raw"])


def match_files(cited: DataFrame, files: DataFrame) -> DataFrame:
    """cited (file_path) to files (path): equal, else one ends with the other, else equal base names; ties to the lesser path.

    Suffixes are exploded on both sides, so every tier is an equi-join.
    """
    parts = lambda c: F.split(c, "/")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/"))
    c = cited.select("file_path").distinct()
    exact = c.join(files.select(F.col("path").alias("file_path"), "path").distinct(), "file_path").withColumn("tier", F.lit(1))
    # Of all files with one ending, or one name, the least is what counts: one row a key meets the cited ones.
    least = lambda key: files.select("path", key).groupBy("k").agg(F.min("path").alias("path"))
    longer = c.join(least(F.explode(tails(F.col("path"))).alias("k")).withColumnRenamed("k", "file_path"), "file_path").withColumn("tier", F.lit(2))
    shorter = c.select("file_path", F.explode(tails(F.col("file_path"))).alias("path")).join(files.select("path").distinct(), "path").withColumn("tier", F.lit(2))
    base = c.withColumn("k", basename(F.col("file_path"))).join(least(basename(F.col("path")).alias("k")), "k").withColumn("tier", F.lit(3))
    cols = ["file_path", "path", "tier"]
    every = exact.select(cols).unionByName(longer.select(cols)).unionByName(shorter.select(cols)).unionByName(base.select(cols))
    return every.groupBy("file_path").agg(F.min(F.struct("tier", "path")).alias("m")).select("file_path", "m.path", "m.tier")


def edge_names(edges: DataFrame) -> DataFrame:
    """(source, target, type) by id and by short name: one row per way to write an edge."""
    use = edges.filter("target_id is not null")
    both = use.select("type", F.explode(F.array_distinct(F.array("source_id", last_dotted(F.col("source_id"))))).alias("source"), "target_id")
    return both.select("type", "source", F.explode(F.array_distinct(F.array("target_id", last_dotted(F.col("target_id"))))).alias("target")).distinct()


def classify(citations: DataFrame, entities: DataFrame, edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Each citation with ``entity_id``, ``symbol`` and ``kind``: definition, call_site or unsupported.

    The flags come from independent equi-joins and meet in one ordered CASE: no file or
    no overlap is unsupported; no or its own symbol, a symbol that contains it or an
    unknown one is a definition; a symbol that calls it (or calls the parent of a
    variable) is a call site; any other edge is a definition.
    """
    key = ["answer_id", "raw"]
    citations = cut(citations, "citations")
    files = entities.select("file_path", F.lit(True).alias("has_file")).distinct()
    hit = overlapping(citations, entities).select(*key, "entity_id")
    names = entities.select(F.col("name").alias("symbol")).distinct() if symbols is None else symbols
    words = citations.select(*key, F.posexplode(F.regexp_extract_all("before", F.lit(r"\w+"), F.lit(0))).alias("i", "symbol"))
    said = words.join(names, "symbol", "left_semi").groupBy(*key).agg(F.max_by("symbol", "i").alias("symbol"))
    e = entities.select(F.col("id").alias("entity_id"), "name", F.col("type").alias("entity_type"), "parent_id")
    df = citations.join(files, "file_path", "left").join(hit, key, "left").join(said, key, "left").join(e, "entity_id", "left")
    ways = edge_names(edges)
    short = df.select(*key, "symbol", F.explode(F.array("entity_id", last_dotted(F.col("entity_id")))).alias("target")).filter("symbol is not null and target is not null")
    met = short.join(ways.withColumnRenamed("source", "symbol"), ["symbol", "target"])
    flags = met.groupBy(*key).agg(F.bool_or(F.col("type") == "CONTAINS").alias("contains"), F.bool_or(F.col("type") == "CALLS").alias("calls"), F.lit(True).alias("other"))
    up = df.filter("entity_type = 'variable' and parent_id is not null").select(*key, "symbol", F.col("parent_id").alias("target"))
    up = up.join(ways.filter("type = 'CALLS'").withColumnRenamed("source", "symbol"), ["symbol", "target"], "left_semi").select(*key, F.lit(True).alias("parent_calls"))
    df = df.join(flags, key, "left").join(up.distinct(), key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (
        F.when(~yes("has_file") | F.col("entity_id").isNull(), "unsupported")
        .when(F.col("symbol").isNull() | (F.col("symbol") == F.col("name")) | yes("contains"), "definition")
        .when(yes("calls") | yes("parent_calls"), "call_site")
        .when(yes("other"), "definition")
        .otherwise("unsupported")
    )
    return df.select(*citations.columns, "entity_id", "symbol", kind.alias("kind"))


def report(classified: DataFrame) -> DataFrame:
    """Counts per answer, the rate of unsupported citations (0 without any) and of supported ones (null without any)."""
    bad = F.count_if(F.col("kind") == "unsupported")
    return classified.groupBy("answer_id").agg(
        F.count("*").alias("total"), bad.alias("unsupported"), F.coalesce(bad / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hallucination_rate")
    ).withColumn("hit_rate", 1 - F.col("unsupported") / F.nullif(F.col("total"), F.lit(0)))


def correct(answers: DataFrame, fixes: DataFrame) -> DataFrame:
    """Replace every bad tag (answer_id, bad, good) in its answer, one after the other in the order of the tags."""
    per = fixes.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.struct("bad", "good"))).alias("_f"))
    df = answers.join(per, "answer_id", "left")
    text = F.aggregate("_f", F.col("answer"), lambda a, f: F.replace(a, f["bad"], f["good"]))
    return df.withColumn("answer", F.coalesce(text, "answer")).drop("_f")


def badges(citations: DataFrame) -> DataFrame:
    """Number tags by first appearance in their answer, from 1."""
    return citations.withColumn("badge", F.dense_rank().over(W.partitionBy("answer_id").orderBy("pos")))
