"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line
are counted. Lines above the limit are removed and documents that lose too much with
them are rejected.

Copies of a document are not distinct documents: were they counted one by one, every
group of copies would turn its own text into boilerplate and be rejected as a whole.
So each class of copies counts once, told by a signature that leaves out what many
documents hold. Each line has a sketch, the least hashes of its windows. A line is
shared if its sketch meets hashes that more than ``min_docs`` documents hold, as lines
of boilerplate, of large groups of copies and edited ones of both do. The signature is
the least hash of the lines that are not shared, however few words they have; only a
document without any such line takes the least of its rarest shared hashes, which copies
of one group agree on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scope
from .common import NO_ID, NOT_WS, WS, stored, table, words

#: Hashes of a line's sketch.
SKETCH = 8
SYMBOLS = r"[^#*$%&|<>]+"


def _windows(hashes: Column) -> Column:
    """Hash of every five-word window, in order; empty below five words."""
    return F.when(
        F.size(hashes) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the base counts and what the method needs, under names with ``_q_``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_q_words", words(text))
    df = df.withColumn("_q_hashes", F.transform("_q_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_q_win", _windows(F.col("_q_hashes")))
    placed = F.sort_array(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_some", F.size(F.array_distinct("_q_win")) < F.size("_q_win"))
    df = df.withColumn("_q_placed", F.when(F.col("_q_some"), placed))
    same = lambda s, k: F.coalesce(F.get("_q_placed", k)["h"] == s["h"], F.lit(False))
    again = F.filter("_q_placed", lambda s, i: same(s, i - 1) | same(s, i + 1))
    df = df.withColumn("_q_at", F.sort_array(F.transform(again, lambda s: s["i"])))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate(
        "_q_at", first,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).cast("long").alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WS))
    df = df.withColumn("_q_lines", lines)
    return df.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })


def _norm(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"{WS}+", " ")))


def _sketch(hashes: Column) -> Column:
    """The least hashes of a line's windows: of five words, or of three in lines under twenty; of all words below three."""
    n = F.when(F.size(hashes) >= 20, 5).otherwise(3)
    window = lambda i: F.when(n == 5, F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])).otherwise(F.xxhash64(*[F.get(hashes, i + k) for k in range(3)]))
    found = F.when(F.size(hashes) >= 3, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), window)).otherwise(F.array(F.xxhash64(hashes)))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, SKETCH)


def _signatures(base: DataFrame, held: DataFrame, min_docs: int) -> DataFrame:
    """_q_d and _q_print of each document that holds one of the lines ``held`` (_q_host, _q_h, _q_n, _q_s)."""
    lines = base.select("_q_d", "_q_host", F.posexplode("_q_parts").alias("_q_i", "_q_p"))
    lines = lines.select("_q_d", "_q_host", "_q_i", F.col("_q_p.h").alias("_q_h"), F.col("_q_p.w").alias("_q_w"), F.col("_q_p.s").alias("_q_s"))
    of_held = stored(lines.select("_q_d", "_q_host", "_q_h").join(held.select("_q_host", "_q_h"), ["_q_host", "_q_h"]).distinct(), "quality_held")
    docs = of_held.select("_q_d").distinct()
    # Shuffled at every size, as it must be at large ones.
    own = lines.join(docs.hint("merge"), "_q_d", "left_semi").join(held.select("_q_host", "_q_h"), ["_q_host", "_q_h"], "left_anti")
    own = stored(own.select("_q_d", "_q_host", "_q_i", "_q_w", "_q_s"), "quality_rest")
    hashes = own.select("_q_host", F.explode("_q_s").alias("_q_v"), F.lit(1).cast("long").alias("n"))
    hashes = hashes.unionByName(held.select("_q_host", F.explode("_q_s").alias("_q_v"), F.col("_q_n").alias("n")))
    # Counts by powers of four, so that copies with edits at different places agree on which are rarest.
    level = F.floor(F.log2(F.col("n")) / 2).cast("int").alias("_q_level")
    shared = hashes.groupBy("_q_host", "_q_v").agg(F.sum("n").alias("n")).filter(F.col("n") > min_docs).select("_q_host", "_q_v", level)
    shared = stored(shared, "quality_shared")
    rare = F.struct(F.col("_q_level").alias("l"), F.col("_q_v").alias("v"))
    met = own.select("_q_d", "_q_host", "_q_i", F.explode("_q_s").alias("_q_v")).join(shared, ["_q_host", "_q_v"])
    met = met.groupBy("_q_d", "_q_i").agg(F.count("*").alias("n"), F.min(rare).alias("rare"))
    own = own.select("_q_d", "_q_i", "_q_w", F.size("_q_s").alias("size"), F.array_min("_q_s").alias("v")).join(met, ["_q_d", "_q_i"], "left")
    # Three words may well meet by chance, so one such hash is not enough.
    free = F.coalesce(F.col("n"), F.lit(0)) < F.when(F.col("_q_w") >= 20, 1).otherwise(F.least(F.lit(2), F.col("size")))
    own = own.select("_q_d", F.when(free, F.col("v")).alias("v"), "rare")
    rarest = held.select("_q_host", "_q_h", F.explode("_q_s").alias("_q_v")).join(shared, ["_q_host", "_q_v"]).groupBy("_q_host", "_q_h").agg(F.min(rare).alias("rare"))
    none = F.lit(None).cast("long")
    every = own.unionByName(of_held.join(rarest, ["_q_host", "_q_h"]).select("_q_d", none.alias("v"), "rare"))
    out = every.groupBy("_q_d").agg(F.min("v").alias("v"), F.min("rare").alias("rare"))
    return of_held.join(out.select("_q_d", F.coalesce("v", "rare.v").alias("_q_print")), "_q_d")


def _prepared(docs: DataFrame, id_col: str, text_col: str, host_col: str, keep: list[str], min_words: int, max_repeat: int) -> DataFrame:
    """``keep``, the keys of a row, base counts and its distinct normalised lines, each with its words and its sketch; written once."""
    keyed = docs.withColumns({
        "_q_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
        "_q_th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null"))),
        "_q_host": F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null")),
    })
    base = base_counts(keyed, text_col)
    base = base.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
    )
    hashed = F.transform(F.transform("_q_lines", _norm), lambda x: F.struct(F.xxhash64(x).alias("h"), F.transform(words(x), lambda w: F.xxhash64(w)).alias("x")))
    part = lambda p: F.struct(p["h"].alias("h"), F.size(p["x"]).alias("w"), _sketch(p["x"]).alias("s"))
    base = base.withColumn("_q_parts", F.array_distinct(F.transform(hashed, part)))
    base = base.withColumn("_q_d", F.xxhash64(*_KEYS))
    return stored(base.select(*keep, *_KEYS, *_BASE, "_q_d", "_q_parts"), "quality")


def _lines(base: DataFrame) -> DataFrame:
    lines = base.select(*_KEYS, F.explode("_q_parts").alias("_q_line"))
    return lines.select(*_KEYS, F.col("_q_line.h").alias("_q_h"), F.col("_q_line.w").alias("_q_w"), F.col("_q_line.s").alias("_q_s"))


def _counted(base: DataFrame, min_docs: int, max_doc_share: float) -> tuple[DataFrame, DataFrame]:
    """(hosts, lines): _q_limit of each host, and _q_rows and _q_docs (classes of copies) of each line that more than both limits hold."""
    lines = _lines(base)
    hosts = base.groupBy("_q_host").agg((F.count("*") * F.lit(float(max_doc_share))).alias("_q_limit"))
    # Only lines that enough rows hold can be frequent; of these, classes of copies are counted.
    held = lines.groupBy("_q_host", "_q_h").agg(F.count("*").alias("_q_n")).filter(F.col("_q_n") > min_docs)
    held = held.join(hosts, "_q_host").filter(F.col("_q_n") > F.col("_q_limit")).drop("_q_limit")
    held = stored(held, "quality_lines")
    # The sketch is the line's, so that of any one row does.
    sketches = lines.select("_q_host", "_q_h", "_q_s").join(held, ["_q_host", "_q_h"]).groupBy("_q_host", "_q_h", "_q_n").agg(F.min("_q_s").alias("_q_s"))
    sketches = stored(sketches, "quality_lines")
    classes = _signatures(base, sketches, min_docs).select("_q_host", "_q_h", "_q_print").distinct()
    counted = classes.groupBy("_q_host", "_q_h").agg(F.count("*").alias("_q_docs"))
    return hosts, counted.join(sketches.select("_q_host", "_q_h", F.col("_q_n").alias("_q_rows")), ["_q_host", "_q_h"])


def _frequent(base: DataFrame, min_docs: int, max_doc_share: float) -> DataFrame:
    """_q_host and _q_h of the frequent lines, written so that a shuffle of its own can split hot ones."""
    hosts, counted = _counted(base, min_docs, max_doc_share)
    over = counted.filter(F.col("_q_docs") > min_docs).join(hosts, "_q_host").filter(F.col("_q_docs") > F.col("_q_limit"))
    return stored(over.select("_q_host", "_q_h"), "quality_frequent")


def line_frequencies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_doc_share: float = 1e-4
) -> DataFrame:
    """host, line (hash of the normalised line), n_rows, n_docs (distinct texts) and n_classes (of copies) of every line
    that more than ``min_docs`` rows of a host, and more than ``max_doc_share`` of them, hold: quality_rules decides by the
    classes. Null hosts are one host."""
    base = _prepared(docs, id_col, text_col, host_col, [], 0, 100)
    _, counted = _counted(base, min_docs, max_doc_share)
    counted = stored(counted, "quality_counts")
    # A row of each line and text first, so that no line's texts meet in one task.
    texts = _lines(base).select("_q_host", "_q_h", "_q_th").join(counted.select("_q_host", "_q_h"), ["_q_host", "_q_h"]).distinct()
    counted = counted.join(texts.groupBy("_q_host", "_q_h").agg(F.count("*").alias("_q_texts")), ["_q_host", "_q_h"])
    host = F.when(F.col("_q_host") != "\x00null", F.col("_q_host"))
    return counted.select(host.alias("host"), F.col("_q_h").alias("line"), F.col("_q_rows").alias("n_rows"), F.col("_q_texts").alias("n_docs"), F.col("_q_docs").alias("n_classes"))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat: int = 20,
    min_docs: int = 20,
    max_doc_share: float = 1e-4,
    max_removed: float = 0.7,
    clean: bool = False,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_frequent_words and kept; with ``clean``, also clean_text, the text
    without its frequent lines; without ``with_text``, the text itself is left out.

    A line is frequent in a host if more classes of copies hold it than ``min_docs``
    and than ``max_doc_share`` of the host's rows. A document is rejected if it has
    fewer than ``min_words`` words, if over ``max_repeat`` percent of its words lie in
    repeated windows, or if over ``max_removed`` of the words of its distinct lines, or
    all but fewer than ``min_words``, are in frequent lines.

    Null texts have no words and are rejected; null hosts are one host; rows equal in
    id and text get equal results, each row its own; texts are taken whole; an empty
    table stays empty. Columns of ``docs`` with the names above are replaced; names
    that begin with ``_q_`` are the operator's own.
    """
    keep = [c for c in docs.columns if c.lower() not in _MADE and (with_text or clean or c != text_col)]
    # The words and windows of a text are worked out once; what follows reads these few columns.
    base = _prepared(docs, id_col, text_col, host_col, keep, min_words, max_repeat)
    with scope() as kept:
        frequent = _frequent(base, min_docs, max_doc_share)
        kept.append(frequent)
    # Only rows of frequent lines come out; Spark broadcasts them if they are few.
    lost = _lines(base).drop("_q_s").join(frequent, ["_q_host", "_q_h"])
    per_doc = lost.select("_q_id", "_q_th", "_q_host", "_q_h", "_q_w").distinct().groupBy("_q_id", "_q_th", "_q_host").agg(
        F.sum("_q_w").alias("n_frequent_words"), *([F.collect_set("_q_h").alias("_q_gone")] if clean else [])
    )
    words_of = F.aggregate("_q_parts", F.lit(0).cast("long"), lambda a, s: a + s["w"])
    body = base.select(*keep, *_KEYS, *_BASE, words_of.alias("_q_all"))
    out = body.join(per_doc, ["_q_id", "_q_th", "_q_host"], "left")
    gone = F.coalesce(F.col("n_frequent_words"), F.lit(0)).cast("long")
    depleted = (gone > F.lit(float(max_removed)) * F.col("_q_all")) | ((gone > 0) & (F.col("_q_all") - gone < min_words))
    out = out.withColumns({"n_frequent_words": gone, "kept": ~F.col("base_failed") & ~depleted})
    made = [*_BASE, "n_frequent_words", "kept"]
    if clean:
        every = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
        left = F.filter(every, lambda x: ~F.coalesce(F.array_contains("_q_gone", F.xxhash64(_norm(x))), F.lit(False)))
        out = out.withColumn("clean_text", F.when(F.col("_q_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
        made.append("clean_text")
    return out.select(*keep, *made)


_KEYS = ["_q_id", "_q_th", "_q_host"]
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_MADE = {*_BASE, "n_frequent_words", "kept", "clean_text"}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, with_text=False).drop("source")
