"""Best-fit packing by pattern packing.

A sequence holds ``capacity`` tokens. Only the histogram of piece lengths, which has
at most ``capacity`` bins whatever the size of the corpus, reaches the driver. There,
patterns of two to four lengths that fill a sequence exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded
within the pieces there are; what is left is packed best-fit, largest first, by counts
of equal lengths. The plan (intervals of ranks within a length) goes back as a bounded
table, and every piece finds its place by its rank within its length.
"""

from __future__ import annotations

import bisect
import operator
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, rules, small_batches, stored, table, tokenizer

#: Buckets by which ranks within a length are counted; bounds the rows of one window.
RANK_BUCKETS = 4096


_ids: dict[str, WordCache] = {}


def encode(path: str, text: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers.

    Where the vocabulary drops white space and no pre-token crosses it, the ids of a text
    are those of its words; words repeat, so their ids are kept in a bounded cache. With
    other rules, the whole text is encoded at once.
    """
    if rules(path) != "words":
        ids = tokenizer(path).encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)
    if path not in _ids:
        _ids[path] = WordCache(path, True, lambda ids: struct.pack(f"<{len(ids)}I", *ids), operator.add)
    return b"".join(map(_ids[path].__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most ``capacity`` ids: piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType
    out = T.StructType([
        T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = (encode(vocabulary, text) if text else b"") + tail
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    took.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(took, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=out.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, out)


def patterns(hist: np.ndarray, capacity: int, per_length: int) -> np.ndarray:
    """Exact fills of two to four pieces out of lengths that occur; unused places are 0.

    Triples and quads take their smaller members from at most ``per_length`` lengths,
    spread evenly over the pieces, which bounds the number of patterns.
    """
    have = np.nonzero(hist)[0]
    have = have[(have > 0) & (have < capacity)]
    found = [np.empty((0, 4), dtype=np.int64)]
    if not len(have):
        return found[0]
    lo = have[have * 2 <= capacity]
    pair = lo[hist[capacity - lo] > 0]
    found.append(np.stack([pair, capacity - pair, 0 * pair, 0 * pair], 1))
    mass = np.cumsum(hist[have])
    picks = np.unique(have[np.searchsorted(mass, np.linspace(0, mass[-1] - 1, per_length), side="right").clip(0, len(have) - 1)])
    a, b = (x.ravel() for x in np.meshgrid(picks, have, indexing="ij"))
    c = capacity - a - b
    ok = (a <= b) & (c >= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = hist[c] > 0
    found.append(np.stack([a[ok], b[ok], c[ok], 0 * c[ok]], 1))
    few = picks[:: max(1, len(picks) // 24)]
    a, b, c = (x.ravel() for x in np.meshgrid(few, few, have, indexing="ij"))
    d = capacity - a - b - c
    ok = (a <= b) & (b <= c) & (d >= c)
    a, b, c, d = a[ok], b[ok], c[ok], d[ok]
    ok = hist[d] > 0
    found.append(np.stack([a[ok], b[ok], c[ok], d[ok]], 1))
    return np.concatenate(found)


def nnls(pats: np.ndarray, hist: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram.

    Accelerated projected gradient; the incidence matrix is never built, as a pattern
    has at most four entries.
    """
    size = len(hist)
    target = hist.astype(float)
    target[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(pats[:, j], weights=x, minlength=size) for j in range(4))
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return sum(r[pats[:, j]] for j in range(4))

    v = np.ones(len(pats))
    for _ in range(12):
        v = back(forward(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    x = np.zeros(len(pats))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def fill(hist: np.ndarray, capacity: int, per_length: int = 96, steps: int = 150) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), for every piece of the histogram."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    pats = patterns(left, capacity, per_length)
    if len(pats):
        fit = nnls(pats, left, steps)
        for i in np.argsort(-fit, kind="stable"):
            if fit[i] < 0.02:
                break
            need = Counter(int(v) for v in pats[i] if v)
            k = min(int(np.ceil(fit[i])), *(int(left[v]) // m for v, m in need.items()))
            if k > 0:
                for v, m in need.items():
                    left[v] -= k * m
                plan.append((tuple(sorted(need.elements(), reverse=True)), k))
    # Best fit by counts: equal sequences are one entry, whatever their number.
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, what: tuple[int, ...], k: int) -> None:
        if room not in open_ or not open_[room]:
            if room not in rooms:
                bisect.insort(rooms, room)
        open_[room][what] = open_[room].get(what, 0) + k

    for v in range(capacity - 1, 0, -1):
        c = int(left[v])
        while c:
            at = bisect.bisect_left(rooms, v)
            while at < len(rooms) and not open_[rooms[at]]:
                rooms.pop(at)
            if at == len(rooms):
                per = capacity // v
                if c >= per:
                    put(capacity - per * v, (v,) * per, c // per)
                    c %= per
                else:
                    put(capacity - c * v, (v,) * c, 1)
                    c = 0
                continue
            room = rooms[at]
            what, k = next(iter(open_[room].items()))
            take = min(c, k)
            if take == k:
                del open_[room][what]
            else:
                open_[room][what] = k - take
            put(room - v, what + (v,), take)
            c -= take
    for sets in open_.values():
        plan += list(sets.items())
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Intervals of ranks within each length: where the first goes, others follow."""
    used: Counter[int] = Counter()
    rows, seq = [], 0
    for what, k in plan:
        at = 0
        for v in what:
            rows.append((v, used[v], seq, at))
            used[v] += k
            at += v
        seq += k
    return pd.DataFrame(rows, columns=["length", "first", "seq", "at"]).astype("int64")


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` is a tokenizer file that every executor has. Null texts are empty: one
    piece that holds the end id alone. Very long texts are encoded whole and cut into
    pieces; a task holds the ids of one text at a time. Repeated rows are
    packed one by one; other columns are not read, so their names cannot clash; an
    empty table gives no rows. Ties (pieces of equal length) take places in the order
    of a hash of id, start and crc; equal pieces are interchangeable.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        cut = stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    key = F.xxhash64(F.col(id_col), "start", "ids_crc32")
    cut = cut.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(RANK_BUCKETS)).cast("int"))
    # Ranks within a length: a count for each (length, bucket), then a window within.
    # capacity * RANK_BUCKETS rows at most, each a sum made where the pieces are.
    counts = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    where = places(fill(hist, capacity)).sort_values(["length", "first"])
    spots = {int(v): g[["first", "seq", "at"]].to_numpy() for v, g in where.groupby("length")}
    shared = spark.sparkContext.broadcast(spots)

    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
    within = W.partitionBy("length", "_bucket").orderBy("_key", id_col, "start")
    ranked = cut.withColumn("_in", F.row_number().over(within) - 1)
    ranked = ranked.join(before.select("length", "_bucket", "_before"), ["length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, at = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for v in np.unique(n):
            rows = np.nonzero(n == v)[0]
            first, base, off = shared.value[int(v)].T
            i = np.searchsorted(first, r[rows], side="right") - 1
            seq[rows] = base[i] + r[rows] - first[i]
            at[rows] = off[i]
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    out = ranked.withColumn("_p", place("length", F.col("_before") + F.col("_in")))
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
