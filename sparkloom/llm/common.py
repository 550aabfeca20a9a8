"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut

#: White space that separates words; everything else belongs to a word.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
#: Stands for a null doc_id in joins, where null never equals null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than one read of these files. They
    are deleted when ``tables.scope`` ends or the driver's process does.
    """
    return cut(df, name, group_rows)


@contextmanager
def small_batches(spark: SparkSession, size: str = "1m", rows: int = 512) -> Iterator[None]:
    """What is worked out within hands texts to Python in batches of about ``size``, and reads ``rows`` of Parquet at once.

    Spark's defaults are 64 MB and 4096 rows a task, and buffers double as they grow, so
    long texts cost an executor several times that beside its heap. The batches hold the
    same rows, each of them whole.
    """
    own = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drawn(df: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` rows in the order of a hash of ``key`` (unique), or all if there are no more.

    Only hashes below a bound that holds them many times over in likelihood are sorted,
    so what partitions hand on does not grow with their number.
    """
    n = df.count()
    if n <= most:
        return df
    bound = min(2**63 - 1, -(2**63) + int((1.3 * most + 1000) / n * 2**64))
    return df.filter(F.xxhash64(key) <= bound).orderBy(F.xxhash64(key), key).limit(most)


def words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_id(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two columns, never null, that tell rows apart by id and text.

    Rows that are equal in both get the same pair and are treated alike.
    """
    return (
        F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("\x00null"))).alias("_th"),
    )


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Entries of a Python worker's cache of words and of the letters in them, some 150 bytes each.
CACHE_ENTRIES = 400_000
CACHE_CORES = 500_000
#: Longer words hardly ever repeat and are not kept.
CACHE_CHARS = 10
#: ASCII punctuation that forms one pre-token after letters. The apostrophe is not among it: it may begin a contraction.
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


@lru_cache(maxsize=8)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


# The rules of the two kinds of vocabulary that have fast ways, as their files state them.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORDS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
]
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


@lru_cache(maxsize=8)
def rules(path: str) -> str:
    """``bytes`` or ``words`` if the vocabulary's normaliser and pre-tokens are of that kind, else ``other``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, split = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    cut = lambda x: {k: v for k, v in x.items() if k != "trim_offsets"}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    # A special token must not look like a word, or a word could be one.
    marks = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and re.fullmatch(r"<\|\w+\|>", t["content"]) for t in spec.get("added_tokens") or [])
    if not (plain and marks):
        return "other"
    if before is None and cut(split) == _BYTES and not model.get("end_of_word_suffix"):
        return "bytes"
    if (before or {}).get("normalizers") == _LOWER and [cut(x) for x in split.get("pretokenizers", [])] == _WORDS and model.get("end_of_word_suffix"):
        return "words"
    return "other"


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordCache(dict):
    """What ``made`` gives for the ids of a word, kept for short words while there is room.

    The ids are the vocabulary's library's: by its model alone where the word is Latin
    letters and then plain punctuation, whose pre-tokens are certain, and by the whole
    tokenizer otherwise. The pre-tokens have a cache of their own.
    """

    def __init__(self, path: str, lower: bool, made, join):
        self.tok, self.lower, self.made, self.join = tokenizer(path), lower, made, join
        self.model, self.letters, self.parts = self.tok.model, byte_letters(), {}

    def _add(self, text: str):
        letters = text.encode().decode("latin-1").translate(self.letters)
        value = self.made([t.id for t in self.model.tokenize(letters)])
        if len(self.parts) >= CACHE_CORES:
            self.parts.clear()
        self.parts[text] = value
        return value

    def __missing__(self, word: str):
        core = word.rstrip(_ENDS)
        value = self.parts.get(core.lower() if self.lower else core)
        if value is None:
            bare = core if self.lower else core.removeprefix(" ")
            if not bare.isalpha() or max(bare) > "\xff":
                return self.made(self.tok.encode(word, add_special_tokens=False).ids)
            value = self._add(core.lower() if self.lower else core)
        if len(core) < len(word):
            end = word[len(core) :]
            value = self.join(value, self.parts.get(end) or self._add(end))
        if len(word) <= CACHE_CHARS and len(self) < CACHE_ENTRIES:
            self[word] = value
        return value
