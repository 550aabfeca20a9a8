"""BPE encoding and decoding with forced-boundary splitting.

A pair of bytes that stands inside no token of the vocabulary can never be merged, so
wherever a text holds such a pair there is a boundary between tokens. Texts are cut at
these places, the fragments are encoded one by one, and their ids are put together
again. Fragments repeat, so each Python worker keeps the ids of short ones.

The vocabulary's library cuts a text into pre-tokens first, and a cut must not change
those. It does not where the two characters tell what the pre-tokens around them are
(``_certain``); elsewhere a forced pair is left alone, which costs a longer fragment
and nothing else. Vocabularies with other rules are encoded text by text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_letters, fresh, rules, table, tokenizer

#: Characters from here on are never beside a cut: libraries may differ on what they are.
_KNOWN = 0x250
#: Kinds of characters, as the byte-level pattern tells them apart; 0 is never beside a cut.
_LETTER, _NUMBER, _OTHER, _SPACE, _APOSTROPHE = 1, 2, 3, 4, 5
#: Entries of a worker's cache of fragments, and the longest fragment kept.
CACHE_ENTRIES = 150_000
CACHE_CHARS = 16
#: Rows of a batch that are made and handed on at once.
ROWS = 256
#: Code points whose cuts are found at once.
STRETCH = 1 << 20


def _kind(c: str) -> int:
    if c in "\t\n\v\f\r ":
        return _SPACE
    if c == "'":
        return _APOSTROPHE
    if "\x1c" <= c <= "\x1f" or c in "\x85\xa0":  # white space to some libraries only
        return 0
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


def _certain(a: int, b: int) -> bool:
    """Whether a cut between characters of these kinds leaves all pre-tokens as they are, or splits one of them there.

    White space before anything else looks ahead, so a cut there is not certain; white
    space before white space is: the last of a run is what differs, and it stays on the
    right. An apostrophe at the start may begin a contraction, which it cannot after
    another mark.
    """
    if not a or not b:
        return False
    if a == _SPACE:
        return b == _SPACE
    if b == _APOSTROPHE:
        return a in (_LETTER, _NUMBER)
    return not (a == _APOSTROPHE and b == _LETTER)


@lru_cache(maxsize=4)
def inside(path: str) -> np.ndarray:
    """256 x 256: which pairs of bytes stand inside a token of the vocabulary, added ones among them."""
    back = {c: b for b, c in byte_letters().items()}
    found = np.zeros((256, 256), dtype=bool)
    tok = tokenizer(path)
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    for t in tok.get_vocab(with_added_tokens=True):
        b = np.frombuffer(t.encode() if t in added else bytes(back[c] for c in t), dtype=np.uint8)
        found[b[:-1], b[1:]] = True
    return found


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per known character: its last byte with its kind, its first byte with its kind; and for both whether to cut."""
    chars = [chr(c) for c in range(_KNOWN)]
    kinds = np.array([_kind(c) for c in chars] + [0])
    last = np.array([c.encode()[-1] for c in chars] + [0])
    first = np.array([c.encode()[0] for c in chars] + [0])
    certain = np.array([[_certain(a, b) for b in range(6)] for a in range(6)])
    left, right = last * 6 + kinds, first * 6 + kinds
    cut = ~inside(path)[:, None, :, None] & certain[None, :, None, :]
    return left, right, cut.reshape(256 * 6, 256 * 6)


def boundaries(path: str, text: str) -> list[int]:
    """The places of ``text`` where it is cut, in code points, in order."""
    left, right, cut = _tables(path)
    found: list[int] = []
    for at in range(0, len(text), STRETCH):
        part = np.frombuffer(text[at : at + STRETCH + 1].encode("utf-32-le"), dtype="<u4")
        part = np.minimum(part, _KNOWN)
        found += (np.flatnonzero(cut[left[part[:-1]], right[part[1:]]]) + at + 1).tolist()
    return found


class _Fragments(dict):
    """Fragment to its ids as little-endian bytes."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)

    def __missing__(self, fragment: str) -> bytes:
        ids = np.array(self.tok.encode(fragment, add_special_tokens=False).ids, dtype="<i4").tobytes()
        if len(fragment) <= CACHE_CHARS and len(self) < CACHE_ENTRIES:
            self[fragment] = ids
        return ids


_fragments: dict[str, _Fragments] = {}


def encode(path: str, text: str) -> bytes:
    """The ids of ``text``, little-endian 32-bit."""
    if path not in _fragments:
        _fragments[path] = _Fragments(path)
    known = _fragments[path]
    if rules(path) != "bytes":
        return _Fragments.__missing__(known, text) if text else b""
    places = boundaries(path, text)
    return b"".join([known[text[a:b]] for a, b in zip([0, *places], [*places, len(text)], strict=True)]) if text else b""


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> list[bytes]:
    """By id: the bytes of a token; none for ids that the vocabulary does not have."""
    tok, back = tokenizer(path), {c: b for b, c in byte_letters().items()}
    by_id = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
    plain = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    return [plain(by_id[i]) if i in by_id else b"" for i in range(max(by_id) + 1)]


def decode(path: str, ids: np.ndarray) -> str:
    """The text of ``ids``, as the library gives it with special tokens; bytes that are no UTF-8 become U+FFFD."""
    if rules(path) != "bytes":
        return tokenizer(path).decode(ids.tolist(), skip_special_tokens=False)
    tokens = _bytes_of(path)
    return b"".join([tokens[i] if 0 <= i < len(tokens) else b"" for i in ids.tolist()]).decode("utf-8", "replace")


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, made: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with ``out``, made of ``column`` a few rows at a time, so that a worker never holds what a whole batch gives."""
    kept, own = [c for c in df.columns if c.lower() != out.lower()], fresh(df, "_made")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, made(part.column(column))], [*b.schema.names, own])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(own, kind)])).select(*kept, F.col(own).alias(out))


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in ``out``, equal to the library's without added special tokens.

    ``vocabulary`` is a tokenizer file that every executor has. Null and empty texts have
    no ids; strings of special tokens inside a text are those tokens, as is the library's
    default; texts of any length are taken whole, in time proportional to their length;
    repeated rows are encoded one by one; an empty table stays empty. No row moves. A
    column that has the name of ``out`` is replaced, whatever its case.
    """

    def made(texts: pa.Array) -> pa.Array:
        parts = [encode(vocabulary, t) if t else b"" for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))

    return _mapped(docs, text_col, out, T.ArrayType(T.IntegerType()), made)


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids in ``out``; special tokens are written out.

    Null and empty ids give an empty text, null ids among others and ids outside the
    vocabulary nothing, and bytes that form no character U+FFFD. Other columns stay; one
    that has the name of ``out`` is replaced.
    """

    def made(rows: pa.Array) -> pa.Array:
        return pa.array([decode(vocabulary, x.values.fill_null(-1).to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in rows], pa.string())

    return _mapped(df, ids_col, out, T.StringType(), made)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_decode(bpe_encode(docs, path).drop("text"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
