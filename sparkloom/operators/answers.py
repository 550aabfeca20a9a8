"""What models answer: status blocks, memory blocks, error classes, and the texts that go in."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CITATION, docstring

# Statuses, the tag of the structured block and keywords of error classes.
STATUSES = ("answered", "insufficient", "rewrite_search")
TAG = r"(?is)<answer_json>\s*(.*?)\s*</answer_json>"
QUOTA_WORDS = ("rate limit", "rate_limit", "429", "quota", "per day", "daily", "tokens per day", "payment required")
LARGE_WORDS = (
    "request entity too large", "request_too_large", "request too large", "context_length_exceeded", "maximum context length", "tokens per minute",
    "context window", "input is too long",
)
AUTH_WORDS = ("401", "403", "unauthorized", "forbidden", "invalid api key", "authentication", "invalid_api_key")
ANSWER = "status string, answer string, partial_answer string, reason string, missing string, rewrite_query string, ltm_entry string"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def model_error_kind(message: Column) -> Column:
    """quota (the next model, this one is exhausted), too_large (the next model), auth or provider (the cascade stops)."""
    m = F.lower(message)
    return F.when(_any(m, QUOTA_WORDS), "quota").when(_any(m, LARGE_WORDS), "too_large").when(_any(m, AUTH_WORDS), "auth").otherwise("provider")


def first_object(text: Column, key: str | None = None) -> Column:
    """The first JSON object in a text, with ``key`` if given; null without one.

    Objects nest, which no expression of the engine can follow, so this scans in Arrow batches.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = json.JSONDecoder().raw_decode

        def one(t: str | None) -> str | None:
            at = t.find("{") if t else -1
            while at >= 0:
                try:
                    found, _ = decode(t, at)
                    if isinstance(found, dict) and (key is None or key in found):
                        return json.dumps(found, ensure_ascii=False)
                except ValueError:
                    pass
                at = t.find("{", at + 1)
            return None

        for b in batches:
            yield pd.Series([one(t) for t in b], dtype=object)

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scan, "string")(text)


def parse_answers(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with status, answer_text, partial, reason, missing, rewrite_query and ltm_entry.

    The tagged block counts if it is JSON, else the first object with a status. An
    answer is the prose before the tag, else the object's answer, else all; a text
    without an object, or of an unknown status, is answered.
    """
    tagged = F.regexp_extract(raw, TAG, 1)
    df = df.withColumn("_t", F.when(F.try_parse_json(tagged).isNotNull() & F.trim(tagged).startswith("{"), tagged))
    df = df.withColumn("_j", F.coalesce("_t", first_object(F.when(F.col("_t").isNull(), F.col(raw)), "status")))
    df = df.withColumn("_o", F.from_json("_j", ANSWER))
    at = F.instr(F.lower(raw), "<answer_json>")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    prose = F.nullif(F.when(at > 0, strip(F.substring(F.col(raw), F.lit(1), at - 1))).otherwise(""), F.lit(""))
    status = F.when(F.col("_j").isNull() | F.col("_o.status").isNull() | ~F.col("_o.status").isin(*STATUSES), "answered").otherwise(F.col("_o.status"))
    full = F.coalesce(prose, F.nullif(F.col("_o.answer"), F.lit("")), strip(F.col(raw)))
    text = F.when(status == "answered", F.when(F.col("_j").isNull(), F.col(raw)).otherwise(full))
    partial = F.when(status == "insufficient", F.coalesce(F.nullif(F.col("_o.partial_answer"), F.lit("")), prose))
    more = {x: F.col(f"_o.{x}") for x in ("reason", "missing", "rewrite_query", "ltm_entry")}
    return df.withColumns({"status": status, "answer_text": text, "partial": partial, **more}).drop("_t", "_j", "_o")


def memory_object(raw: Column) -> Column:
    """The memory that a model extracted, as JSON: the whole text without its fence, else from the first to the last brace; null otherwise."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"^\s*(?:```(?:json)?)?\s*", ""), r"\s*(?:```)?\s*$", "")
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    is_object = lambda c: F.try_parse_json(c).isNotNull() & c.startswith("{")
    return F.when(is_object(clean), clean).when(is_object(braces), braces)


def embedding_text(kind: Column, name: Column, source: Column, has_docstring: Column) -> Column:
    doc = F.when(F.coalesce(has_docstring, F.lit(False)), docstring(source)).otherwise("")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Type: "), blank(kind), F.lit("\nName: "), blank(name), F.lit("\nDocstring: "), doc, F.lit("\n\n"), blank(source))


# The headings of blocks, in the four functions below.
def history_with_summary(summary: Column) -> Column:
    """The rolling summary under its heading; empty without one."""
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("[Conversation summary so far]\n"), summary)).otherwise("")


def with_memory(context: Column, feature: Column, confidence: Column, exploration: Column, summary: Column) -> Column:
    """Context with the session's memory before it; as it is without one."""
    block = F.concat(
        F.lit("\n=== LONG-TERM MEMORY (from earlier in this session) ===\nFeature: "), feature, F.lit("\nConfidence: "), confidence,
        F.lit("  |  Exploration: "), exploration, F.lit("\n"), summary, F.lit("\n=== END LONG-TERM MEMORY ===\n"),
    )
    return F.concat(F.coalesce(block, F.lit("")), context)


def with_language_note(prompt: Column, note: Column) -> Column:
    return F.concat(prompt, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("\n\n# Repository language coverage\n"), note, F.lit("\n"))).otherwise(""))


def entity_block(label: Column, indent: str = "") -> Column:
    """An entity (type, name, file_path, start_line, end_line, source) under a label, its source indented."""
    head = F.format_string(
        f"{indent}[%s]\n{indent}  Type    : %s\n{indent}  Name    : %s\n{indent}  Citation: [%s:%d-%d]", label, F.col("type"), F.col("name"), F.col("file_path"), F.col("start_line"), F.col("end_line")
    )
    code = F.regexp_replace(F.regexp_replace(F.col("source"), r"\n$", ""), r"(?m)^", f"{indent}    ")
    return F.concat(head, F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.concat(F.lit(f"\n{indent}  Source:\n"), code)).otherwise(""))


def sentence_range(files: Column, detailed: bool) -> Column:
    """How many sentences a folder's summary has, by its files."""
    if detailed:
        return F.when(files <= 2, "6-7").when(files <= 5, "7-8").otherwise("8-10")
    return F.when(files <= 3, "3-4").when(files <= 6, "4-5").otherwise("5-6")


def merge_chunks(chunks: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """One text per key out of the summaries of its chunks, in order; all but the first are marked as continued."""
    per = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_x"))
    part = F.transform("_x", lambda v, i: F.concat(F.when(i > 0, "(continued) ").otherwise(""), v[text]))
    return per.select(*keys, F.array_join(part, " ").alias(text))


def resplit(items: DataFrame, budgets: Mapping[str, int] | int, text: str, chunk) -> DataFrame:
    """Items (chunk_index, total_chunks, text) that a model refused, cut anew for the next one: sub-chunk ``idx`` of
    ``n`` gets chunk_index * n + idx of total_chunks * n, so no chunk of a file takes another's place."""
    parts = items.withColumn("_c", chunk(F.col(text), budgets)).withColumn("_n", F.size("_c"))
    rows = parts.select(*[c for c in items.columns if c not in (text, "chunk_index", "total_chunks")], "chunk_index", "total_chunks", "_n", F.posexplode("_c").alias("_i", text))
    return rows.withColumns({"chunk_index": F.col("chunk_index") * F.col("_n") + F.col("_i"), "total_chunks": F.col("total_chunks") * F.col("_n")}).drop("_n", "_i")


def default_plan(df: DataFrame, question: str) -> DataFrame:
    """The plan without a planner: a search for the question, confidence 0."""
    return df.withColumns({"intent": F.lit("query"), "retrieval_strategy": F.lit("semantic_search"), "search_query": F.col(question), "confidence": F.lit(0.0)})


def without_citations(answer: Column) -> Column:
    """The answer of an overview: its inline tags go."""
    return F.trim(F.regexp_replace(answer, CITATION, ""))
