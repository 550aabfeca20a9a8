"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of learned rotations (principal directions, then a rotation that
brings the points close to the corners of a cube) fitted to a bounded sample. A code is
split into substrings of sixteen bits, each with an index from value to rows. If two codes
differ in at most r bits, one of m substrings differs in at most r // m, so probing the
values that near to the query's in every index retrieves every code within r. These are
then ranked by the cosine of the vectors themselves. Codes are made once for every row. The radius is read off the sample:
nearest neighbours in a sample are farther than in all rows, so it errs on the wide side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, stored, table


class Codes:
    """Rotations and radius; small, and shipped to the tasks."""

    def __init__(self, mean: np.ndarray, turns: list[np.ndarray], radius: int):
        self.mean, self.turns, self.radius = mean, turns, radius

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        bits = np.concatenate([(u - self.mean) @ t > 0 for t in self.turns], 1)
        return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16))), axis=1)


def learn(sample: np.ndarray, rotations: int = 2, steps: int = 30, k: int = 5, recall: float = 0.98, seed: int = 11) -> Codes:
    """Fit rotations, and the radius that holds ``recall`` of the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    u = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean, d = u.mean(0), u.shape[1]
    y = u - mean
    directions = np.linalg.eigh(y.T @ y)[1][:, ::-1]
    turns = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        p = y @ directions
        for _ in range(steps):
            a, _, b = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (a @ b).T
        turns.append(directions @ r)
    codes = Codes(mean, turns, rotations * d)
    probe = np.arange(0, len(u), max(1, len(u) // 400))
    if len(u) > k + 1:
        c = codes.encode(u)
        s = u[probe] @ u.T
        s[np.arange(len(probe)), probe] = -2
        top = np.argpartition(-s, k, axis=1)[:, :k]
        apart = np.bitwise_count(c[probe][:, None, :] ^ c[top]).sum(2)
        codes.radius = int(np.quantile(apart, recall, method="higher"))
    return codes


def probe(code: np.ndarray, want: np.ndarray, radius: int) -> Iterator[tuple[slice, np.ndarray]]:
    """For 64 queries at a time, which rows some index admits: a superset of those within the radius."""
    words, asked = code.view(np.uint16), want.view(np.uint16)
    m = words.shape[1]
    near = radius // m
    # One index per substring: the values that occur, and each row's place among them.
    tables = [np.unique(words[:, t], return_inverse=True) for t in range(m)]
    for lo in range(0, len(want), 64):
        at = slice(lo, lo + 64)
        found = np.zeros((len(want[at]), len(code)), dtype=bool)
        for t, (values, place) in enumerate(tables):
            found |= (np.bitwise_count(asked[at, t, None] ^ values[None, :]) <= near)[:, place]
        yield at, found


def _search(index: pd.DataFrame, queries: pd.DataFrame, radius: int, k: int) -> pd.DataFrame:
    """The k best rows of one block of the index for each query of one block."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(index) or not len(queries):
        return none
    index = index.sort_values("vec_id")
    ids, x = index["vec_id"].to_numpy(), np.stack(index["v"].to_list()).astype(np.float64)
    qid, q = queries["vec_id"].to_numpy(), np.stack(queries["v"].to_list()).astype(np.float64)
    code, want = (np.frombuffer(b"".join(d["code"]), dtype=np.uint8).reshape(len(d), -1) for d in (index, queries))
    norm, qnorm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    out = []
    for at, found in probe(code, want, radius):
        for i, mine in enumerate(found, at.start):
            rows = np.nonzero(mine)[0]
            apart = np.bitwise_count(code[rows] ^ want[i]).sum(1)
            rows = rows[(apart <= radius) & (ids[rows] != qid[i])]
            if len(rows) < k:  # too few within the radius here: the next codes, whatever their distance
                apart = np.bitwise_count(code ^ want[i]).sum(1)
                rows = np.argsort(apart, kind="stable")[: k + 1 + len(rows)]
                rows = rows[ids[rows] != qid[i]]
            score = (x[rows] * q[i]).sum(1) / (norm[rows] * qnorm[i])
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), qid[i]), ids[rows][best], score[best]))
    if not out:
        return none
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    sample_rows: int = 8_000,
    rows_per_block: int = 8_192,
    queries_per_block: int = 16_384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query by cosine.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do those of another length than most of the sample's, nor rows with a null id. Codes
    are fitted to ``sample_rows`` rows at most, the first by a hash of the id; every row
    is indexed. Ties go to the smaller id. A query is not its own candidate; rows that
    repeat an id are one row, the one with the greater vector. Other columns are not
    read; without vectors or queries there are no rows.

    The index is coded once and cut into blocks of rows by a hash of the id, and so are
    the queries; each pair of blocks is a task, so the work follows queries * rows, no
    task grows with either, and a row is shuffled once for 16 384 queries. Pigeonhole
    probing prunes as the radius allows: of nearly uniform vectors it admits most rows,
    of clustered ones few.
    """
    spark = vectors.sparkSession
    sound = F.size("v") > 0
    sound &= ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)

    def ready(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(sound).groupBy("vec_id").agg(F.max("v").alias("v"))

    index = stored(ready(vectors), "vectors")
    sample = drawn(index, "vec_id", sample_rows).select("v").collect()
    shape = "query_id long, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(r["v"]) for r in sample])
    d = int(np.bincount(lengths).argmax())
    codes = learn(np.array([r["v"] for r in sample if len(r["v"]) == d]), k=k)
    shared = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([bytes(c) for c in shared.value.encode(np.stack(b.to_list()).astype(np.float64))] if len(b) else [], dtype=object)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    coded = lambda df: df.filter(F.size("v") == d).withColumn("code", F.pandas_udf(encode, "binary")("v"))
    index, asked = stored(coded(index), "index"), stored(coded(ready(queries)), "queries")
    blocks = max(1, -(-index.count() // rows_per_block))
    sets = max(1, -(-asked.count() // queries_per_block))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = index.withColumn("block", at(blocks)).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.withColumn("set", at(sets)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    radius = codes.radius

    def search(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return _search(rows, some, radius, k)

    found = left.groupBy("block", "set").cogroup(right.groupBy("block", "set")).applyInPandas(search, shape)
    # Best k of what the blocks found: at most k rows of each block and query.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
