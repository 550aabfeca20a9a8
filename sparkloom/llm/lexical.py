"""Ranked lexical search with block-max pruning.

The index has a row per block, a range of documents in the order of the table, or in one
that puts those of one language and of like length side by side: the forward index of its documents (which terms, how often) and, per term of the block, the
largest part that any of its documents can add to a score. From these maxima follows a
bound on what any document of the block can score for a query. Each query's blocks of
the highest bounds are scored first; the k-th best score found there is a threshold,
and of all other blocks only those are scored whose bound reaches it. What is left out
cannot be among the best, so the results are those of scoring everything.

A batch of queries is answered with three passes over the index, two of which read the
columns of maxima only. Queries come in groups of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: A term: letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on the bytes of UTF-8: capitals become small, what belongs to no term a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Scores in units of the contract: saturation, and how much a document's length counts, in hundredths.
UNIT, ONE, LENGTH, PART = 1_000_000_000, 1000, 8, 90
#: Queries, and their terms, that are answered at once; both are held by every task.
MAX_QUERIES, MAX_TERMS = 1024, 500_000
#: Documents whose blocks are read at once; a task's memory does not grow with its part of the index.
READ_DOCS = 2048
#: Terms whose hashes a worker keeps.
CACHE_ENTRIES = 100_000

_BLOCK = "block long, doc_id array<long>, n array<long>, at array<int>, slot array<int>, tf array<int>, term array<long>, peak array<long>, df array<int>"


@dataclass(frozen=True)
class Index:
    """The rows of blocks, and what all documents have together: documents with a term, and terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _place(text: bytes) -> tuple[bytes, int] | None:
    """Where a document stands in the order of blocks; None without a term."""
    found = Counter(terms_of(text))
    return (max(found.items(), key=lambda x: (x[1], x[0]))[0], found.total()) if found else None


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(term)
        h -= (h >> 63) << 64
        if len(self) < CACHE_ENTRIES:
            self[term] = h
        return h


_hashes = _Hashes()


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    """How a document's length counts against it: 100 at the mean length."""
    return 100 - PART + PART * n * n_docs // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score, per unit of its weight. Grows with tf and falls with m."""
    return UNIT * tf // (ONE * tf + LENGTH * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(values), kind))


def _row(docs: list[tuple[int | None, Counter]], number: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A block out of documents with their terms."""
    n = np.array([c.total() for _, c in docs])
    at = np.cumsum([0, *(len(c) for _, c in docs)])
    term, slot = np.unique(np.array([_hashes[t] for _, c in docs for t in c], dtype=np.int64), return_inverse=True)
    tf = np.array([x for _, c in docs for x in c.values()], dtype=np.int64)
    m = np.array([length_part(int(x), n_docs, n_terms) for x in n], dtype=np.int64)
    order = np.argsort(slot, kind="stable")
    df = np.bincount(slot)
    peak = np.maximum.reduceat(impact(tf, np.repeat(m, np.diff(at)))[order], np.cumsum([0, *df[:-1]]))
    ids = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array([d for d, _ in docs], pa.int64()))
    columns = {"block": pa.array([number], pa.int64()), "doc_id": ids, "n": _lists([n], pa.int64())}
    columns |= {k: _lists([v], pa.int32()) for k, v in (("at", at), ("slot", slot), ("tf", tf))}
    columns |= {"term": _lists([term], pa.int64()), "peak": _lists([peak], pa.int64()), "df": _lists([df], pa.int32())}
    return pa.RecordBatch.from_pydict(columns)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_block: int = 64, like_together: bool = False) -> Index:
    """The block index of whole texts, as a table in the shared folder; any number of searches may read it.

    Terms are told apart by 64-bit hashes. Null texts and texts without a term are in no
    block; repeated rows are documents of their own; null ids stay null; an empty table
    gives an index without blocks. With ``like_together``, the rows that a task reads at
    once are ordered by their most frequent term and their length first: terms are found
    twice, and searches score fewer blocks, so it is for an index that many searches read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms_of(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"docs": [sum(map(bool, n))], "terms": [sum(n)]})

    stats = docs.select(text).mapInArrow(counted, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = stats["docs"] or 0, stats["terms"] or 0

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            ids, texts, order = b.column(0).to_pylist(), b.column(1), range(b.num_rows)
            if like_together:  # no more than a block's terms are held at once
                places = [_place(t.as_py()) for t in texts]
                order = sorted((i for i in order if places[i]), key=places.__getitem__)
            for i in order:
                if found := Counter(terms_of(texts[i].as_py())):
                    held.append((ids[i], found))
                if len(held) == per_block:
                    yield _row(held, number, n_docs, n_terms)
                    number, held = number + 1, []
        if held:
            yield _row(held, number, n_docs, n_terms)

    rows = docs.select(F.col(id_col).cast("long"), text).mapInArrow(blocks, _BLOCK)
    return Index(stored(rows, "block_index", max(1, READ_DOCS // per_block)), n_docs, n_terms)


@dataclass
class _Queries:
    """A group of queries: the terms of all, and per query the places of its own among them."""

    terms: np.ndarray
    own: list[np.ndarray]
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.flat = np.concatenate([*self.own, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.ends = np.cumsum([0, *(len(x) for x in self.own)])

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's terms (sorted): their places among the queries' terms, and which of the block's they are."""
        if not len(self.terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        mine = np.flatnonzero(self.terms[at] == term)
        return at[mine], mine

    def bounds(self, places: np.ndarray, peak: np.ndarray) -> np.ndarray:
        """Per query, what no document of a block with these maxima can exceed."""
        added = np.zeros(len(self.terms), dtype=np.int64)
        added[places] = self.weights[places] * peak
        sums = np.concatenate([[0], np.cumsum(added[self.flat])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


class _Best:
    """The k best documents of each query so far: by score, then by id (null ids first)."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.copy(), {}

    def add(self, q: int, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least[q])
        if not len(good):
            return
        new = list(zip((-scores[good]).tolist(), (~nulls[good]).tolist(), ids[good].tolist(), strict=True))
        self.found[q] = best = sorted([*self.found.get(q, []), *new])[: self.k]
        if len(best) == self.k:  # those that tie with the last may have smaller ids
            self.least[q] = max(self.least[q], -best[-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(q, i if known else None, -s) for q, best in self.found.items() for s, known, i in best]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["q", "doc_id", "score"])


def _arrays(b: pa.RecordBatch, *names: str) -> Iterator[list]:
    """Row by row, the columns' values as arrays; ids with nulls stay Arrow's."""
    for i in range(b.num_rows):
        yield [x.values if (x := b.column(n)[i]).values.null_count else x.values.to_numpy(zero_copy_only=False) for n in names]


def _summed(qs: _Queries) -> Callable:
    """How many documents of the blocks read hold each of the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(qs.terms), dtype=np.int64)
        for b in batches:
            for term, df in _arrays(b, "term", "df"):
                places, mine = qs.places(term)
                total[places] += df[mine]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["t", "df"])

    return run


def _highest(qs: _Queries, first: int) -> Callable:
    """Of the blocks read, those of each query's highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = bounds = None
        for b in batches:
            new = np.array([qs.bounds(places, peak[mine]) for term, peak in _arrays(b, "term", "peak") for places, mine in [qs.places(term)]]).reshape(-1, len(qs.own))
            blocks = np.broadcast_to(b.column("block").to_numpy()[:, None], new.shape) if blocks is None else np.concatenate([blocks, np.broadcast_to(b.column("block").to_numpy()[:, None], new.shape)])
            bounds = new if bounds is None else np.concatenate([bounds, new])
            order = np.lexsort((blocks, -bounds), axis=0)[:first]
            blocks, bounds = np.take_along_axis(blocks, order, 0), np.take_along_axis(bounds, order, 0)
        if bounds is not None:
            i, q = np.nonzero(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(blocks[i, q], pa.int64()), pa.array(bounds[i, q], pa.int64())], ["q", "block", "bound"])

    return run


def _scored(qs: _Queries, k: int, least: np.ndarray, n_docs: int, n_terms: int, chosen: bool) -> Callable:
    """The best documents of the blocks read, for the queries that a block is chosen for, or else for those whose threshold its bound reaches.

    Blocks of a batch are taken by their highest bound, so that thresholds rise early.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, least)
        for b in batches:
            rows = [(places, mine, qs.bounds(places, peak[mine])) for term, peak in _arrays(b, "term", "peak") for places, mine in [qs.places(term)]]
            order = sorted(range(len(rows)), key=lambda i: -int((rows[i][2] - best.least).max(initial=-1)))
            for i in order:
                places, mine, bounds = rows[i]
                mine_q = np.flatnonzero((bounds > 0) & (bounds >= best.least))
                if chosen:
                    mine_q = np.intersect1d(mine_q, np.asarray(b.column("qs")[i].values))
                if len(mine_q):
                    _score(next(_arrays(b.slice(i, 1), "doc_id", "n", "at", "slot", "tf", "term")), qs, places, mine, mine_q, best, n_docs, n_terms)
        yield best.batch()

    return run


def _score(row: list, qs: _Queries, places: np.ndarray, mine: np.ndarray, which: np.ndarray, best: _Best, n_docs: int, n_terms: int) -> None:
    """Scores the documents of one block for the queries ``which``."""
    ids, n, at, slot, tf, term = row
    nulls = np.zeros(len(n), dtype=bool)
    if isinstance(ids, pa.Array):
        nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    column = np.full(len(term), -1)
    column[mine] = np.arange(len(mine))
    doc, held = np.repeat(np.arange(len(n)), np.diff(at)), column[slot]
    known = held >= 0
    m = np.array([length_part(int(x), n_docs, n_terms) for x in n], dtype=np.int64)
    parts = np.zeros((len(mine), len(n)), dtype=np.int64)
    parts[held[known], doc[known]] = impact(tf[known].astype(np.int64), m[doc[known]]) * qs.weights[places][held[known]]
    back = np.full(len(qs.terms), -1)
    back[places] = np.arange(len(places))
    for q in which.tolist():
        own = back[qs.own[q]]
        best.add(q, ids, nulls, parts[own[own >= 0]].sum(axis=0))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    w = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _group(index: Index, qs: _Queries, k: int, first: int) -> DataFrame:
    """(q, rank, doc_id, score) of one group of queries."""
    blocks, spark = index.blocks, index.blocks.sparkSession
    df = np.zeros(len(qs.terms), dtype=np.int64)
    for r in blocks.select("term", "df").mapInArrow(_summed(qs), "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r["t"]] = r["df"]  # as many rows as the group has terms
    qs.weights = np.array([weight(int(x), index.n_docs) if x else 0 for x in df], dtype=np.int64)

    highest = blocks.select("block", "term", "peak").mapInArrow(_highest(qs, first), "q int, block long, bound long")
    w = W.partitionBy("q").orderBy(F.desc("bound"), "block")
    highest = highest.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    # At most ``first`` blocks a query: bounded by the size of a group.
    chosen = stored(highest.groupBy("block").agg(F.collect_set("q").alias("qs")), "first_blocks")
    least = np.ones(len(qs.own), dtype=np.int64)
    scored = blocks.join(F.broadcast(chosen), "block").mapInArrow(_scored(qs, k, least, index.n_docs, index.n_terms, True), "q int, doc_id long, score long")
    for r in _top(scored, k).filter(F.col("rank") == k).select("q", "score").collect():
        least[r["q"]] = r["score"]
    return _top(blocks.mapInArrow(_scored(qs, k, least, index.n_docs, index.n_terms, False), "q int, doc_id long, score long"), k)


@lru_cache(maxsize=1)
def _hash_terms() -> Callable[[Column], Column]:
    @F.udf("array<long>", useArrow=True)
    def run(text):
        return sorted({_hashes[t] for t in terms_of(bytes(text or b""))})

    return run


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, first: int = 8) -> DataFrame:
    """Each query's ``k`` best documents above 0: id_col, rank (from 1), doc_id, score; equal scores by id.

    ``first`` blocks a query are scored to get its threshold. A query counts each of its
    terms once; null texts and texts without a known term find nothing. Rows that repeat
    a query's id are queries of their own; null ids of queries stay, null ids of documents
    come before others of the same score. Other columns are not looked at. Queries are
    answered in groups of at most ``MAX_QUERIES`` queries; an empty table of either gives
    no rows.
    """
    spark = queries.sparkSession
    found = stored(queries.select(F.col(id_col).alias("_id"), _hash_terms()(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_terms")).filter(F.size("_terms") > 0), "queries")
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("_terms")).alias("terms")).first()
    n_groups = max(math.ceil(size["n"] / MAX_QUERIES * 2), math.ceil((size["terms"] or 0) / MAX_TERMS * 2)) if size["n"] > MAX_QUERIES or (size["terms"] or 0) > MAX_TERMS else 1
    out = None
    for g in range(n_groups):
        rows = found.filter(F.pmod(F.xxhash64("_id", "_terms"), F.lit(n_groups)) == g).orderBy("_id", "_terms").collect() if n_groups > 1 else found.orderBy("_id", "_terms").collect()
        for at in range(0, len(rows), MAX_QUERIES):
            part = rows[at : at + MAX_QUERIES]
            terms = np.unique(np.concatenate([np.array(r["_terms"], dtype=np.int64) for r in part]))
            qs = _Queries(terms, [np.searchsorted(terms, np.array(r["_terms"], dtype=np.int64)) for r in part])
            ids = spark.createDataFrame([(q, r["_id"]) for q, r in enumerate(part)], f"q int, `{id_col}` {queries.schema[id_col].dataType.simpleString()}")
            got = _group(index, qs, k, first).join(F.broadcast(ids), "q").select(id_col, "rank", "doc_id", "score")
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], f"`{id_col}` {queries.schema[id_col].dataType.simpleString()}, rank int, doc_id long, score long")


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
OP12_SQL = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS terms FROM documents
), stats AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), lengths AS (
  SELECT r, doc_id, 100 - 90 + (90 * len(terms) * n_docs) // n_terms AS m FROM docs, stats WHERE len(terms) > 0
), wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark
), tfs AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY r, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), stats
), parts AS (
  SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM tfs JOIN lengths USING (r) JOIN weights USING (t)
), scores AS (
  SELECT item_id, r, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (t) GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scores JOIN lengths USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
