"""Search, context assembly and walks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import token_estimate
from ..sources.tables import cut
from . import graph
from .ordered import batches

# Priorities of roles in the context; deeper callees than two are left out.
PRIORITY = {"core": 1, "callee1": 2, "child": 2, "caller": 3, "callee2": 4, "parent": 5, "base": 6}
TOKEN_BUDGET = 6000
#: Characters that every snippet has besides its own values.
LEAST_SNIPPET = 48


def search(rows: DataFrame, query: Sequence[float], k: int, where: Column | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest by cosine, exactly; null and zero vectors are left out; ties to the lesser id."""
    df = rows if where is None else rows.where(where)
    df = df.withColumn("score", vectors.cosine(F.col(vector_col), vectors.literal(query))).filter("score is not null")
    return df.orderBy(F.desc("score"), id_col).limit(k)


def ranked(results: DataFrame, order: list) -> DataFrame:
    """1-based rank of a result set of bounded size (a top-k)."""
    return results.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def priority(role: Column, depth: Column) -> Column:
    return (
        F.when(role == "core", 1).when((role == "callee") & (depth == 1), 2).when(role == "child", 2).when(role == "caller", 3)
        .when((role == "callee") & (depth == 2), 4).when(role == "parent", 5).when(role == "base", 6)
    )


def context_items(core: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, priority, seq): every entity once, at its best place; seq orders core results."""
    own = core.select("id", F.lit(1).alias("priority"), F.col("rank").alias("seq"))
    more = expanded.join(core.select(F.col("id").alias("root"), F.col("rank").alias("seq")), "root")
    more = more.select("id", priority(F.col("role"), F.col("depth")).alias("priority"), "seq").filter("priority is not null")
    best = own.unionByName(more).groupBy("id").agg(F.min(F.struct("priority", "seq")).alias("p"))
    return best.select("id", "p.priority", "p.seq")


def within_budget(items: DataFrame, group: list[str], order: list[str], size_col: str, base: int = 0, budget: int = TOKEN_BUDGET, chars: int = 4) -> DataFrame:
    """Items in order, up to the first that overflows the budget of each group; it and all after it are cut.

    Tokens are characters by ``chars``, rounded down, of everything so far.
    """
    w = W.partitionBy(*group).orderBy(*order)
    run = F.sum(size_col).over(w.rowsBetween(W.unboundedPreceding, 0)) + base
    df = items.withColumn("used", run).withColumn("_over", F.floor(F.col("used") / chars) > budget)
    return df.withColumn("_cut", F.max(F.col("_over").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_cut = 0").drop("_over", "_cut")


def snippet(df: DataFrame) -> DataFrame:
    """Entity snippets as the context has them."""
    doc = F.when(F.coalesce(F.col("docstring"), F.lit("")) != "", F.concat(F.lit("Docstring:\n"), "docstring", F.lit("\n"))).otherwise("")
    head = F.format_string("--- Entity: %s %s ---\nCitation: [%s:%d-%d]\n", "type", "name", "file_path", "start_line", "end_line")
    return df.withColumn("snippet", F.concat(head, doc, F.lit("Source Code:\n"), F.coalesce("source", F.lit("")), F.lit("\n\n")))


def retrieve(entities: DataFrame, edges: DataFrame, query: Sequence[float], k: int = 10, budget: int = TOKEN_BUDGET, base: int = 0) -> DataFrame:
    """Search, expand and assemble: the entities of the context in order, with role priority and
    characters so far, of which ``base`` are those of the header and the traces."""
    core = cut(ranked(search(entities, query, k).select("id", "score"), [F.desc("score"), F.col("id")]))
    slim = entities.drop("embedding")
    expanded = graph.expand(core, slim, edges)
    slim = slim if "docstring" in slim.columns else slim.withColumn("docstring", F.lit(None).cast("string"))
    items = snippet(context_items(core, expanded).join(slim, "id")).select("id", "priority", "seq", F.length("snippet").alias("chars"))
    # No snippet is shorter than its fixed text, so more items than these cannot fit: the
    # window runs over a bounded number of rows, whatever the expansion holds.
    fit = 4 * (budget + 1) // LEAST_SNIPPET + 1
    items = items.orderBy("priority", "seq", "id").limit(fit).withColumn("g", F.lit(1))
    return within_budget(items, ["g"], ["priority", "seq", "id"], "chars", base, budget).select("id", "priority", "seq", "used")


def synthetic_score(base: Column, rank: Column) -> Column:
    return F.greatest(F.lit(0.01), base - 0.01 * rank)


def unseen(results: DataFrame, seen: DataFrame) -> DataFrame:
    return results.join(seen.select("id"), "id", "left_anti")


def token_batches(texts: DataFrame, group: list[str], order: list[str], text_col: str, max_tokens: int = 50_000) -> DataFrame:
    """Greedy batches in order: a text that does not fit starts the next batch; a longer one is alone. Rows carry sizes, not texts."""
    slim = texts.select(*group, *order, token_estimate(F.col(text_col), 1).alias("tokens"))
    return batches(slim, group, order, {"tokens": max_tokens})


#: Where Python's splitlines ends a line, kept at its end.
_LINE_ENDS = r"(?<=[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])(?<!\r(?=\n))"


def _line_batches(sizes: Iterator[pd.Series], most: int) -> Iterator[pd.Series]:
    """(first, last, chars) of the greedy chunks of each text, from the lengths of its lines."""
    for column in sizes:
        out = []
        for lengths in column:
            total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            at, chunks = 0, []
            while at < len(lengths):  # a step a chunk
                end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
                chunks.append({"first": at, "last": end - 1, "chars": int(total[end] - total[at])})
                at = end
            out.append(chunks)
        yield pd.Series(out, dtype=object)


def source_chunks(files: DataFrame, keys: list[str], text_col: str, max_tokens: int) -> DataFrame:
    """(keys, chunk, total_chunks, first_line, last_line, chars, text): each text in chunks of at most four characters a token, cut at line ends; a longer line is alone.

    No row moves: chunks follow from the lengths of a text's lines, which are all that
    leaves the JVM, and are read off the text beside it (not at all if ``text`` is dropped).
    """
    most = 4 * max_tokens

    @F.pandas_udf("array<struct<first:int,last:int,chars:long>>")
    def chunks(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _line_batches(sizes, most)

    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), _LINE_ENDS), lambda x: x != "")
    df = files.select(*keys, lines.alias("_lines")).withColumn("_chunks", chunks(F.transform("_lines", F.length)))
    df = df.select(*keys, "_lines", F.size("_chunks").cast("long").alias("total_chunks"), F.posexplode("_chunks").alias("chunk", "c"))
    text = F.array_join(F.slice("_lines", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "")
    return df.select(*keys, F.col("chunk").cast("long").alias("chunk"), "total_chunks", (F.col("c.first") + 1).alias("first_line"), (F.col("c.last") + 1).alias("last_line"), "c.chars", text.alias("text"))


def file_batches(files: DataFrame, repo_col: str, path_col: str, text_col: str, context: int, reserve: int, per_file: int, output: int = 800, share: float = 0.3) -> DataFrame:
    """(repo, path, tokens, kind, chunk, total_chunks, batch): what is sent to a model together.

    A file over the budget (context less reserve, 1000 at least) is a row per chunk, each
    a batch of its own; files under ``share`` of it are packed in the order of paths, up
    to the budget of tokens and up to ``output`` tokens of answers at ``per_file`` each;
    any other file is a batch alone. ``batch`` numbers the packed ones of a repository.
    """
    budget = max(1000, context - reserve)
    df = files.select(repo_col, path_col, token_estimate(F.col(text_col), 1).alias("tokens"), text_col)
    big, rest = df.filter(F.col("tokens") > budget), df.filter(F.col("tokens") <= budget).drop(text_col)
    kind = F.when(F.col("tokens") < share * budget, "packed").otherwise("single")
    rest = rest.withColumns({"kind": kind, "chunk": F.lit(0).cast("long"), "total_chunks": F.lit(1).cast("long"), "answer": F.lit(per_file).cast("long")})
    packed = batches(rest.filter("kind = 'packed'"), [repo_col], [path_col], {"tokens": budget, "answer": output})
    single = rest.filter("kind = 'single'").withColumn("batch", F.lit(None).cast("long"))
    chunks = source_chunks(big, [repo_col, path_col], text_col, budget)
    tokens = F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).cast("long").alias("tokens")
    chunks = chunks.select(repo_col, path_col, tokens, F.lit("chunked").alias("kind"), "chunk", "total_chunks", F.lit(None).cast("long").alias("batch"))
    return packed.unionByName(single).drop("answer").unionByName(chunks)


def line_chunks(text: Column, size: int) -> Column:
    """Chunks at line boundaries, of at most ``size`` characters where lines allow it."""
    start = F.array().cast("array<string>")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    add = lambda a, x: F.when((F.size(a) > 0) & (F.length(last(a)) + F.length(x) + 1 <= size), F.concat(F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), F.array(F.concat(last(a), F.lit("\n"), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.split(text, "\n"), start, add)
