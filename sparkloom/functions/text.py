"""String functions of the engine, as column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EDGE_RANK


# How citations, their placeholders and leaked labels are written.
CITATION = r"\[([^\[\]\s:`]+\.[a-zA-Z0-9]+):(\d+)(?:-(\d+))?\]"
QUOTED_CITATION = r"\[`([^\[\]\s:`]+\.[a-zA-Z0-9]+:\d+(?:-\d+)?)`\]"
PLACEHOLDER = r"(?i)\[([^\[\]\s:`]+\.[a-zA-Z0-9]+):(?:start|end)(?:-(?:\d+|start|end))?\]"
LEAKED_LABEL = r"\*{0,2}Paragraph\s+\d+(?:[–—-]\d+)?\s*[–—-]\s*\*{0,2}"


def canonical_source(source: Column) -> Column:
    """Trim, lower, cut trailing slashes and .git, https for the known hosts, single slashes after the scheme."""
    s = F.regexp_replace(F.lower(F.trim(source)), "/+$", "")
    s = F.regexp_replace(s, r"\.git$", "")
    s = F.regexp_replace(s, r"^http://(github\.com|gitlab\.com|bitbucket\.org)/", "https://$1/")
    at = F.instr(s, "://")
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at + 2), F.regexp_replace(F.substring(s, at + 3, F.length(s)), "/+", "/"))).otherwise(s)


def repo_id(source: Column) -> Column:
    return F.substring(F.sha2(canonical_source(source), 256), 1, 16)


def repo_name(source: Column) -> Column:
    s = F.substring_index(F.substring_index(canonical_source(source), "?", 1), "#", 1)
    parts = F.filter(F.split(F.replace(s, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), canonical_source(source))


def module_id(path: Column, language: Column) -> Column:
    py = F.regexp_replace(F.regexp_replace(path, "^python/", ""), r"\.py$", "")
    ts = F.regexp_replace(F.regexp_replace(path, "^typescript/", ""), r"\.tsx?$", "")
    folder = F.regexp_extract(ts, "^(.*/)?[^/]*$", 1)
    ts = F.concat(F.replace(folder, F.lit("/"), F.lit(".")), F.replace(F.substring_index(ts, "/", -1), F.lit("."), F.lit("_")))
    other = F.lower(F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit(".")))
    return F.when(language == "python", F.concat(F.lit("py."), F.replace(py, F.lit("/"), F.lit(".")))).when(language == "typescript", F.concat(F.lit("ts."), ts)).otherwise(other)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """The whole parent directory; ``.`` at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def last_dotted(identifier: Column) -> Column:
    return F.substring_index(identifier, ".", -1)


def self_references(source: Column) -> Column:
    """How often a source refers to attributes of self; two or more bring a method's parent into the context."""
    return F.regexp_count(F.coalesce(source, F.lit("")), F.lit(r"\bself\.\w+"))


def token_estimate(text: Column, least: int = 0) -> Column:
    """Four characters a token, rounded down."""
    return F.greatest(F.lit(least), F.floor(F.length(text) / 4)).cast("long")


def docstring(source: Column) -> Column:
    """The first triple-quoted string, else the first block comment of two stars without its margin."""
    py = F.regexp_extract(source, r'(?s)"""(.*?)"""|\'\'\'(.*?)\'\'\'', 0)
    doc = F.regexp_extract(source, r"(?s)/\*\*(.*?)\*/", 1)
    inner = F.substring(py, F.lit(4), F.length(py) - 6)
    cut = F.array_join(F.transform(F.split(doc, "\n"), lambda x: F.regexp_replace(x, r"^\s*\*?\s?", "")), "\n")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(source.isNull(), "").when(py != "", strip(inner)).otherwise(strip(cut))


def edge_rank(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in EDGE_RANK.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def normalise_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, QUOTED_CITATION, "[$1]")


def sanitize_citations(answer: Column) -> Column:
    """Without citations whose line numbers are placeholders."""
    return F.regexp_replace(answer, PLACEHOLDER, "")


def strip_leaked_labels(answer: Column) -> Column:
    return F.regexp_replace(answer, LEAKED_LABEL, "")


def progress_encode(message: Column, pct: Column) -> Column:
    return F.when(pct.isNull(), message).otherwise(F.concat(message, F.lit("|pct="), pct.cast("string")))


def progress_pct(message: Column) -> Column:
    """The percentage at the end of a progress message, within 0 and 100; null without one."""
    n = F.regexp_extract(message, r"\|pct=(-?\d+)", 1).try_cast("int")
    return F.when(n.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), n)))


def progress_text(message: Column) -> Column:
    return F.substring_index(F.substring_index(message, "|pct=", 1), "|warn=", 1)


def is_url(source: Column) -> Column:
    return F.trim(source).rlike(r"(?i)^(https?://|git@|git://)")


def safe_path(path: Column) -> Column:
    """Whether no segment climbs to the parent."""
    return ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


# What the messages of ingestion errors hold, in the order in which it is looked for.
def ingest_error_kind(message: Column) -> Column:
    """Class of an ingestion error by what its text holds; the first rule that fits."""
    m = F.lower(message)
    any_of = lambda *xs: functools.reduce(operator.or_, [F.contains(m, F.lit(x)) for x in xs])
    return (
        F.when(any_of("rate limit", "429", "too many"), "rate_limit")
        .when(F.contains(m, F.lit("jina")) & any_of("auth", "401", "invalid", "forbidden", "403"), "key_invalid")
        .when(any_of("jina_api_key", "jina api key"), "key_missing")
        .when(any_of("git clone", "clone failed"), "clone")
        .when(any_of("does not exist", "no such file"), "not_found")
        .when(any_of("timeout", "timed out"), "timeout")
        .when(any_of("jina embed failed after max retries"), "retries")
        .when(any_of("no python or typescript files"), "unsupported")
        .otherwise("other")
    )


def task_type(context: Column, prompt: Column, explicit: Column) -> Column:
    n = F.greatest(F.lit(1), F.floor((F.length(context) + F.length(prompt)) / 4))
    return F.when(explicit.isin("reasoning", "standard", "fast"), explicit).when(n < 500, "fast").otherwise("standard")


def dots(identifier: Column) -> Column:
    return F.length(identifier) - F.length(F.replace(identifier, F.lit("."), F.lit("")))


def source_kind(source: Column) -> Column:
    """How a source is read: cloned from a URL, walked if it is a path; blank sources raise an error."""
    blank = F.coalesce(F.trim(source), F.lit("")) == ""
    return F.when(blank, F.raise_error(F.lit("a source is a URL or a path"))).when(is_url(source), "clone").otherwise("path")


def seconds_to_midnight(ts: Column) -> Column:
    """Seconds until the day ends in UTC, 1 at least."""
    next_day = F.timestamp_add("DAY", F.lit(1), F.date_trunc("day", ts))
    return F.greatest(F.lit(1), F.unix_seconds(next_day.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))).cast("long")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
