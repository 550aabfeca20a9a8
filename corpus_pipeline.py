"""A corpus pipeline out of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.

In every stage: null texts are empty, null sources one source, null ids ids of their
own; whole texts of any length are taken; an empty table gives an empty result. What a
stage decides does not depend on the order of rows, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import n_words, row_id, stored, table
from sparkloom.llm.jaccard import labelled_rows
from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.mixing import mix
from sparkloom.llm.packing import pack
from sparkloom.llm.quality import quality_rules
from sparkloom.sources.tables import scope


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars that fits the text."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; those kept lose the lines that are frequent in their source. Rows that repeat get one verdict."""
    out = quality_rules(docs, clean=True).filter("kept").drop("text").withColumnRenamed("clean_text", "text")
    return _as_documents(out, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents that have no line left then. The first is that of the least id, then hash of the text; rows that repeat stay equal."""
    out = line_dedup(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _as_documents(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, one row stays: the least by id, then by hash of the text. So do documents without words."""
    found = stored(labelled_rows(docs, "doc_id", "text", 5, 80).filter("n > 0").select("label", "_id", "_th"), "components")
    rows = found.groupBy("label", "_id", "_th").count()
    least = rows.groupBy("label").agg(F.min(F.struct("_id", "_th")).alias("_least"))
    rows = stored(rows.join(least, "label").select("_id", "_th", (F.struct("_id", "_th") == F.col("_least")).alias("_stays"), "count"), "stays")
    keyed = docs.select("*", *row_id())
    # Rows that are repeated whole are the only ones that meet.
    once = keyed.join(rows.filter("not _stays or count > 1").select("_id", "_th"), ["_id", "_th"], "left_anti")
    again = keyed.join(rows.filter("_stays and count > 1").select("_id", "_th"), ["_id", "_th"], "left_semi")
    return once.unionByName(again.dropDuplicates(["_id", "_th"])).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows equal in id and text equally often, those without words once."""
    out = mix(docs, F.array("source"), n_words(F.col("text")))
    times = F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_time")
    return out.filter("repeats > 0").select(*docs.columns, times).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens; a text without words is one piece of the end id, and rows that repeat are packed one by one."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", packing),
]

#: Token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope() as kept:  # what a stage has written besides its result goes with it
            docs = stored(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
