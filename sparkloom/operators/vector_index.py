"""A vector index: coarse cells, each a folder, with rows in the order of their angle to the cell's centre.

A search reads the folders of the cells it probes and no others. What else can hold a
neighbour follows from the triangle inequality of angles: a row at angle ``r`` from its
centre is at least ``|angle(query, centre) - r|`` from the query. So a search may be
approximate (the cells nearest to each query) or exact (then those that may still hold
a nearer row than the k-th found), and the exact one skips cells and rows as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Rows that centres are fitted on at most, and cells (folders) at most.
MAX_SAMPLE, MAX_CELLS = 100_000, 4096
#: Rows of one file; a cell that has more has several files, which different tasks read and write.
MAX_FILE_ROWS = 200_000
#: Queries answered by one pass; every task holds their vectors.
MAX_QUERIES = 8192
#: Rows compared at once with all queries of their cell; queries compared at once with all centres.
SLICE = 512
#: Rows found that a task holds beside the best k of each query before it sorts them.
MAX_FOUND = 200_000
#: Angles worked out differently may differ by this much.
SLACK = 1e-6
#: Cosines nearer than this may be equal when rounded to 9 places, which is what ties are; and one that all rows reach.
TIE, NOTHING = 2e-9, -1.5


@dataclass(frozen=True)
class Index:
    """``path`` holds rows (id, embedding, angle) in folders of ``cell``; ``centres`` are unit vectors, ``radius`` and ``count`` those of each cell."""

    path: str
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    id_type: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.id_type}, embedding array<double>, angle double, cell int").parquet(f"{self.path}/rows")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def usable(rows: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """(id, embedding) of the rows that have a direction: no nulls, no values that are not finite, not all zero, and ``dim`` values."""
    v = F.col(vector_col).cast("array<double>")
    df = rows.select(F.col(id_col).alias("id"), v.alias("embedding"))
    df = df.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return df.filter(F.size("embedding") == dim) if dim else df


def _fit(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """Centres by k-means of directions on a sample of at most about ``MAX_SAMPLE`` rows."""
    share = min(1.0, MAX_SAMPLE / max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    model = KMeans(k=max(2, cells), distanceMeasure="cosine", seed=7, maxIter=8, initMode="random").fit(cut(sample.select(array_to_vector("embedding").alias("features")), "vector_sample"))
    return _unit(np.array(model.clusterCenters()))


def build(rows: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None) -> Index:
    """Write the index of ``rows`` to ``path`` (a shared folder), every row in the cell of the nearest centre.

    Rows without a direction (null, zero, not finite) are in no cell; of vectors of
    different lengths those of the most frequent length are indexed. ``cells`` is the
    square root of the number of rows by default. Rows of a cell beyond
    ``MAX_FILE_ROWS`` go to files of their own, by a hash, so a cell that holds a third
    of all rows is neither written nor read by one task. An empty table gives an index
    without cells.
    """
    spark = rows.sparkSession
    sizes = usable(rows, id_col, vector_col).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (sizes["d"], sizes["count"]) if sizes else (0, 0)
    id_type = dict(rows.dtypes)[id_col]
    df = usable(rows, id_col, vector_col, dim)
    if n == 0:
        return Index(path, np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=int), id_type)
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS, n))
    centres = _fit(df, n, cells) if cells > 1 else np.eye(1, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, cell, angle = _unit(_matrix(b.column("embedding"))), [], []
            for at in range(0, len(unit), 1024):
                near = unit[at : at + 1024] @ centres.T
                cell.append(near.argmax(axis=1))
                angle.append(_angle(near.max(axis=1)))
            if len(unit):
                yield b.append_column("angle", pa.array(np.concatenate(angle))).append_column("cell", pa.array(np.concatenate(cell), pa.int32()))

    placed = cut(df.mapInArrow(assign, f"id {id_type}, embedding array<double>, angle double, cell int"), "vector_cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"))
    pieces = stats.select("cell", F.ceil(F.col("n") / MAX_FILE_ROWS).alias("_p"))  # a row a cell
    out = placed.join(F.broadcast(pieces), "cell").withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_p")))
    out = out.repartition("cell", "_p").sortWithinPartitions("cell", "angle").select("id", "embedding", "angle", "cell")
    out.write.mode("overwrite").option("maxRecordsPerFile", MAX_FILE_ROWS).partitionBy("cell").parquet(f"{path}/rows")
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), dtype=int)
    for r in stats.collect():  # as many rows as cells
        radius[r["cell"]], count[r["cell"]] = r["r"], r["n"]
    meta = [(i, c.tolist(), float(radius[i]), int(count[i]), id_type) for i, c in enumerate(centres)]
    spark.createDataFrame(meta, "cell int, centre array<double>, radius double, n long, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Index(path, centres, radius, count, id_type)


def load(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` wrote to ``path``."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Index(path, np.array([c["centre"] for c in cells]), np.array([c["radius"] for c in cells]), np.array([c["n"] for c in cells]), cells[0]["id_type"])


def _near_cells(index: Index, unit: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each query, a row a query."""
    filled = np.flatnonzero(index.count)
    near = [np.argsort(-(unit[at : at + SLICE] @ index.centres[filled].T), axis=1, kind="stable")[:, :n] for at in range(0, len(unit), SLICE)]
    return filled[np.concatenate(near)]


def _may(index: Index, cells: np.ndarray, unit: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which queries may find a row of the cosine ``floor`` in which of ``cells``."""
    return _angle(unit @ index.centres[cells].T) - index.radius[cells] <= _angle(floor)[:, None] + SLACK


def _asking(index: Index, unit: np.ndarray, chosen: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
    """How many queries ask each cell: those that chose it, or with ``floor`` all others that may find something there."""
    out, every = np.zeros(len(index.count), dtype=int), np.arange(len(index.count))
    for at in range(0, len(unit), SLICE):
        part = slice(at, at + SLICE)
        own = np.zeros((len(unit[part]), len(out)), dtype=bool)
        np.put_along_axis(own, chosen[part], True, axis=1)
        out += (own if floor is None else _may(index, every, unit[part], floor[part]) & ~own).sum(axis=0)
    return np.where(index.count > 0, out, 0)


def _scan(index: Index, unit: np.ndarray, own: list | None, k: int, chosen: np.ndarray, floor: np.ndarray | None) -> Callable:
    """The ``k`` nearest rows read of each query, among the cells that it asks (see ``_asking``).

    A cell's rows are compared with all its queries by products of matrices, ``SLICE``
    rows at a time, in the order of their angle to the centre; queries whose angle rules
    a slice out take no part in it. Only what reaches the cosine that a query still looks
    for is looked at one by one; that cosine rises as rows are found.
    """
    spots: dict = {}
    own_at = np.array([spots.setdefault(i, len(spots)) for i in own or []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(unit), NOTHING) if floor is None else floor.copy()
        kept, found, n_found = None, [], 0

        def settle() -> None:
            nonlocal kept, found, n_found
            t = pa.Table.from_batches([*([kept] if kept is not None else []), *found])
            t = t.append_column("r", pa.array(-np.round(t["score"].to_numpy(), 9)))
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("r", "ascending"), ("id", "ascending")], null_placement="at_start"))
            q = t["q"].to_numpy()
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == k - 1
            least[q[last]] = np.maximum(least[q[last]], -t["r"].to_numpy()[last] - TIE)
            kept, found, n_found = t.filter(pa.array(rank < k)).drop_columns("r").combine_chunks().to_batches()[0], [], 0

        for b in batches:
            if not b.num_rows:
                continue
            cells, angles, ids, rows = b.column("cell").to_numpy(), b.column("angle").to_numpy(), b.column("id"), _unit(_matrix(b.column("embedding")))
            spot = np.array([spots.get(i, -1) for i in ids.to_pylist()]) if spots else None
            order = np.lexsort((angles, cells))
            for mine in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                cell, own_cell = cells[mine[0]], (chosen == cells[mine[0]]).any(axis=1)
                asks = np.flatnonzero(own_cell if floor is None else _may(index, cells[mine[:1]], unit, least)[:, 0] & ~own_cell)
                to_centre = _angle(unit[asks] @ index.centres[cell])
                for at in range(0, len(mine), SLICE):
                    some = mine[at : at + SLICE]
                    within = _angle(least[asks]) + SLACK
                    q = asks[(to_centre - within <= angles[some[-1]]) & (to_centre + within >= angles[some[0]])]
                    if not len(q):
                        continue
                    score = unit[q] @ rows[some].T
                    for j in np.flatnonzero(spot[some] >= 0) if spots else ():
                        score[own_at[q] == spot[some[j]], j] = NOTHING - 1
                    hit = score >= least[q][:, None]
                    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
                    if len(many):  # the k-th of the slice itself
                        least[q[many]] = np.maximum(least[q[many]], np.partition(score[many], -k, axis=1)[:, -k] - TIE)
                        hit[many] = score[many] >= least[q[many]][:, None]
                    i, j = np.nonzero(hit)
                    if len(i):
                        i, j = q[i], some[j]
                        found.append(pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), ids.take(pa.array(j)), pa.array(np.einsum("ij,ij->i", unit[i], rows[j]))], ["q", "id", "score"]))
                        n_found += len(i)
                    if n_found > MAX_FOUND:
                        settle()
        if n_found:
            settle()
        if kept is not None:
            yield kept

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id"))).filter(F.col("rank") <= k)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "id", vector_col: str = "embedding", others: bool = False, read: list | None = None) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of each query by cosine, ties to the lesser id.

    ``probes`` cells a query, those of the nearest centres; without it the search is
    exact: after the nearest cells, all others that may hold a nearer row are read.
    ``others`` leaves the row of the query's own id out. Queries without a direction, or
    of another length than the index's, find nothing. Any number of queries: they are
    answered in blocks of ``MAX_QUERIES``, one plan each. To ``read``, a list, goes the
    share of all (query, row) pairs in the cells that each pass probes.
    """
    asked = usable(queries, id_col, vector_col, index.centres.shape[1] or None) if len(index.count) else usable(queries, id_col, vector_col).filter("false")
    asked = cut(asked.withColumn("_b", F.lit(0)), "vector_queries")
    n = asked.count()
    blocks = -(-n // MAX_QUERIES)
    schema = f"q int, id {index.id_type}, score double"
    out = spark.createDataFrame([], f"query_id {dict(asked.dtypes)['id']}, rank int, id {index.id_type}, score double")
    if n == 0:
        return out
    rows = index.rows(spark)
    for block in range(blocks):
        part = asked if blocks <= 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        got = part.select("id", "embedding").collect()  # at most about MAX_QUERIES rows
        if not got:
            continue
        unit, ids = _unit(np.array([r["embedding"] for r in got])), [r["id"] for r in got]
        chosen = _near_cells(index, unit, probes or _first(index, k))

        def probe(floor: np.ndarray | None, unit=unit, ids=ids, chosen=chosen) -> DataFrame:
            asking = _asking(index, unit, chosen, floor)
            if read is not None:
                read.append(int(asking @ index.count) / (len(unit) * int(index.count.sum())))
            some = rows.filter(F.col("cell").isin(np.flatnonzero(asking).tolist()))  # prunes folders
            return some.mapInArrow(_scan(index, unit, ids if others else None, k, chosen, floor), schema)

        first = probe(None)
        if probes is None:
            first = cut(_top(first, k), "vector_first")
            floor = np.full(len(unit), NOTHING)
            for r in first.filter(F.col("rank") == k).select("q", "score").collect():  # a row a query
                floor[r["q"]] = r["score"] - TIE
            first = first.select("q", "id", "score").unionByName(probe(floor))
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {dict(asked.dtypes)['id']}")
        out = out.unionByName(_top(first, k).join(F.broadcast(names), "q").select("query_id", "rank", "id", "score"))
    return out


def _first(index: Index, k: int) -> int:
    """How many of the nearest cells give an exact search its first limit."""
    return max(1, min(len(index.count), round(len(index.count) ** 0.5), 8 + k))
