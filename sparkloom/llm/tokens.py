"""Token counts with overlap resynchronisation for huge documents.

A document of up to ``huge_chars`` code points is cut into units (a run of white
space and the run of other characters after it). No pre-token of the byte-level
pattern crosses the start of a unit, so the sum over units is the library's own
count; units repeat, so their counts are kept in a bounded cache per Python worker.
A longer document is encoded in overlapping chunks with offsets. Two neighbours are
spliced where both end a token at the same code point and the text there proves the
boundary stable (white space that follows another character); if the overlap has no
such place, it is widened until it has one or the text ends.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, rules, table, tokenizer

#: White space other than these two is rare; such texts take the plain path, so that
#: no difference between regex libraries on what white space is can matter.
_ODD = re.compile(r"[^\S \n]")
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Where chunks may be spliced; white space in every library's eyes.
_STABLE = re.compile(r"(?<=\S)[ \n]")


_counts: dict[str, WordCache] = {}


def count_units(path: str, text: str) -> int:
    """Tokens of ``text``, unit by unit; at once if the vocabulary has other rules than the byte-level ones."""
    if rules(path) != "bytes" or _ODD.search(text):
        return len(tokenizer(path).encode(text, add_special_tokens=False))
    if path not in _counts:
        _counts[path] = WordCache(path, False, len, operator.add)
    return sum(map(_counts[path].__getitem__, _UNIT.findall(text)))


def _boundaries(path: str, text: str, start: int, end: int) -> list[int]:
    """Where the tokens of ``text[start:end]`` begin, in the text's offsets."""
    e = tokenizer(path).encode(text[start:end], add_special_tokens=False)
    return [start + a for a, _ in e.offsets]


def _chunk_end(text: str, at: int, overlap_chars: int) -> int:
    """The least end from ``at`` on that leaves a stable place in the chunk's last ``overlap_chars``; the text's end without one."""
    if at >= len(text):
        return len(text)
    place = _STABLE.search(text, max(1, at - overlap_chars))
    return max(at, place.start() + 1) if place else len(text)


def splice(path: str, text: str, chunk_chars: int, overlap_chars: int) -> int:
    """Tokens of ``text`` from overlapping chunks; equal to those of the whole text.

    Chunks reach to a stable place, however far it is; where two chunks do not agree on
    one, the overlap doubles, and then the chunk itself. So every character is encoded
    a bounded number of times, even if none of a million is white space.
    """
    n, total, begin = len(text), 0, 0
    end = _chunk_end(text, chunk_chars, overlap_chars)
    here = _boundaries(path, text, 0, end)
    while end < n:
        last, overlap = _chunk_end(text, end + chunk_chars, overlap_chars), max(1, overlap_chars)
        while True:
            start = max(begin + 1, end - overlap)
            there = _boundaries(path, text, start, last)
            # Stable: no pre-token runs from another character into the white space
            # after it, whatever stands to the left of both chunks.
            cuts = [p for p in set(here) & set(there) if start < p < end and text[p] in " \n" and not text[p - 1].isspace()]
            if cuts:
                cut = max(cuts)
                total += sum(1 for p in here if begin <= p < cut)
                begin, here, end = cut, [p for p in there if p >= cut], last
                break
            if start == begin + 1:
                end = _chunk_end(text, begin + 2 * (end - begin), overlap_chars)
                here = _boundaries(path, text, begin, end)
                break
            overlap *= 2
    return total + sum(1 for p in here if p >= begin)


def count_tokens(path: str, text: str | None, huge_chars: int, chunk_chars: int, overlap_chars: int) -> int:
    if not text:
        return 0
    if len(text) > huge_chars and rules(path) == "bytes":
        return splice(path, text, chunk_chars, overlap_chars)
    return count_units(path, text)


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    huge_chars: int = 50_000,
    chunk_chars: int = 16_384,
    overlap_chars: int = 256,
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``vocabulary`` is a tokenizer file that every executor has. Units and splices are for
    byte-level vocabularies without a normaliser; with other rules, whole texts are encoded
    at once. Null and empty texts have 0 of both; very long ones take time and memory in
    proportion to their length; other columns stay as they are (columns that already have these names are
    replaced); repeated rows are counted one by one; an empty table stays empty.
    """
    def run(batches: Iterable[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_tokens(vocabulary, t, huge_chars, chunk_chars, overlap_chars) for t in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    counted = F.pandas_udf(run, T.LongType())
    return docs.withColumns({
        "n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
        "n_tokens": counted(F.col(text_col)),
    })


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
