"""Running values over ordered groups of any size.

Spark's window over a group is one task's work. Here rows are cut into ranges of the
order, each range is summed up to one row, the few rows of a group are scanned, and
windows run inside ranges only. So a group that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Rows of a range.
RANGE_ROWS = 250_000
#: A block of batches is as many full batches long; of its rows, one in so many meets the others of its group.
BLOCK_BATCHES = 128
#: Rows of a call of Python, about: groups smaller than that share one.
CALL_ROWS = 200_000


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; ``b`` has them with two underscores before."""
    return a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def ranges(rows: DataFrame, group: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``_part``, the number of their range; later ranges hold what comes later in (group, order).

    As many ranges as the number of rows asks for. Rows that agree in all of (group,
    order) are in one range, so the order should tell rows apart.
    """
    rows = cut(rows, "ordered")
    parts = max(1, -(-rows.count() // range_rows))
    return cut(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, group: list[str], order: list[str], sums: Mapping[str, Column], range_rows: int = RANGE_ROWS, *, number: str | None = None) -> DataFrame:
    """``rows`` with ``pos``, their place in the group from 0, and for each of ``sums`` its total up to and with the row.

    With ``number``, a column of that name too, a whole number that tells groups apart.
    """
    t = ranges(rows, group, order, range_rows).withColumns({f"_v_{n}": c for n, c in sums.items()})
    keys = [*group, "_part"]
    totals = t.groupBy(*keys).agg(F.count("*").alias("_o_pos"), *[F.sum(f"_v_{n}").alias(f"_o_{n}") for n in sums])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in ("pos", *sums)])
    if number:  # the range that a group begins in, and its place among those that do
        offsets = offsets.withColumn("_begins", F.min("_part").over(W.partitionBy(*group)))
        place = F.dense_rank().over(W.partitionBy("_begins").orderBy(*group))
        offsets = offsets.withColumn(number, F.shiftleft(F.col("_begins").cast("long"), 32) + place).drop("_begins")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"_v_pos": F.count("*").over(inside) - 1, **{f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}})
    out = _same(t, _renamed(offsets, keys), keys)
    numbered = [number] if number else []
    return out.select(*rows.columns, *numbered, (F.col("_v_pos") + F.col("_o_pos")).alias("pos"), *[(F.coalesce(f"_r_{n}", F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums])


def around(rows: DataFrame, group: list[str], order: str, what: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the last ``what`` that is not null at or before their place of the order, and the first at or after it.

    Rows of one place are peers, whichever range they are in.
    """
    t = ranges(rows, group, [order], range_rows).withColumn("_w", what)
    keys = [*group, "_part"]
    ends = t.groupBy(*keys).agg(F.max_by("_w", F.when(F.col("_w").isNotNull(), F.col(order))).alias("_last"), F.min_by("_w", F.when(F.col("_w").isNotNull(), F.col(order))).alias("_first"))
    by = W.partitionBy(*group).orderBy("_part")
    carried = ends.select(
        *keys, F.last("_last", True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_cb"), F.first("_first", True).over(by.rowsBetween(1, W.unboundedFollowing)).alias("_ca")
    )
    inside = W.partitionBy(*keys).orderBy(order)
    t = t.withColumns({"_b": F.last("_w", True).over(inside.rangeBetween(W.unboundedPreceding, 0)), "_a": F.first("_w", True).over(inside.rangeBetween(0, W.unboundedFollowing))})
    out = _same(t, _renamed(carried, keys), keys)
    return out.select(*rows.columns, F.coalesce("_b", "_cb").alias("before"), F.coalesce("_a", "_ca").alias("after"))


def _ends(sizes: list[np.ndarray], mosts: list[int], stop: np.ndarray) -> np.ndarray:
    """For every row, the row before which a batch that starts there ends, under all limits and before ``stop``."""
    end = stop
    for s, most in zip(sizes, mosts, strict=True):
        total = np.concatenate([[0], np.cumsum(s)])
        end = np.minimum(end, np.searchsorted(total, total[:-1] + most, side="right") - 1)
    return np.maximum(end, np.arange(len(stop)) + 1)


def batches(rows: DataFrame, group: list[str], order: list[str], limits: Mapping[str, int]) -> DataFrame:
    """``rows`` with ``batch``: greedy batches of each group in order; a row that any of ``limits`` (column: most) forbids starts the next one.

    A row that is over a limit by itself is alone. Sizes are whole numbers, those of the
    first limit from 1 on. Where a batch ends follows from where it starts; so the places
    where batches start are a chain, and it is followed without a fold over a group:
    blocks of ``BLOCK_BATCHES`` full batches (by the first limit's running total), each
    with the rows after it that a batch may reach, tell for every row that can begin a
    batch there where the chain leaves the block and after how many batches. Those rows
    are few; a group's are walked once, and then all blocks are cut at the same time.
    A call of Python takes as many blocks as make up ``CALL_ROWS`` rows, of any groups.
    """
    names, mosts, columns = list(limits), [int(m) for m in limits.values()], rows.columns
    first, most = names[0], mosts[0]
    length = most * BLOCK_BATCHES
    # A row over the limit counts as just over it, so that no row is longer than a block.
    t = running(rows, group, order, {"_total": F.least(F.col(first), F.lit(most + 1))}, number="_group")
    start = F.col("_total") - F.least(F.col(first), F.lit(most + 1))
    t = cut(t.withColumns({"_start": start, "_block": F.floor(start / length)}), "batches")
    slim = t.select("_group", "pos", "_start", *names, "_block")
    early = (F.col("_start") - F.col("_block") * length <= most) & (F.col("_block") > 0)
    with_more = slim.withColumn("_own", F.lit(True)).unionByName(slim.filter(early).withColumns({"_block": F.col("_block") - 1, "_own": F.lit(False)}))
    calls = max(1, -(-t.count() // CALL_ROWS))
    call = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(calls)).alias("_call")

    def read(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """The rows by block, for each row the first of its block and the first after it, and where a batch from it ends."""
        g = g.sort_values(["_group", "_block", "pos"], ignore_index=True)
        sizes = [np.minimum(g[n].to_numpy(dtype=np.int64), m + 1) for n, m in zip(names, mosts, strict=True)]
        keys = g[["_group", "_block"]].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(g)]])
        begin, stop = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
        return g, begin, stop, _ends(sizes, mosts, stop)

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        g, _, stop, end = read(g)
        n_rows, own, block, pos = len(g), g["_own"].to_numpy(), g["_block"].to_numpy(), g["pos"].to_numpy()
        # Jump on from every row until its chain has left the block, twice as far each time;
        # the end of the block that ends before row i has the place n_rows + i.
        jump = np.concatenate([np.where(own, np.where(end < stop, end, n_rows + stop), np.arange(n_rows)), np.arange(n_rows, 2 * n_rows + 1)])
        n, inside = np.zeros(len(jump), dtype=np.int64), np.zeros(len(jump), dtype=bool)
        n[:n_rows], inside[:n_rows] = own, own
        while inside[jump].any():
            n, jump = n + n[jump], jump[jump]
        enters = np.flatnonzero(own & np.where(block > 0, g["_start"].to_numpy() - block * length <= most, pos == 0))
        to = jump[enters]
        leaves = np.where(to < n_rows, pos[np.minimum(to, n_rows - 1)], pos[stop[enters] - 1] + 1)
        return pd.DataFrame({"_group": g["_group"].to_numpy()[enters], "_block": block[enters], "pos": pos[enters], "leaves": leaves, "n": n[enters]})

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        out, now, at, batch = [], None, 0, 0
        g = g.sort_values(["_group", "_block", "pos"])
        for i, b, p, leaves, n in zip(*[g[c].tolist() for c in ("_group", "_block", "pos", "leaves", "n")], strict=True):
            if now is None or now[0] != i:
                at, batch = 0, 0
            if now != (i, b):
                now, enter = (i, b), at
                out.append((i, b, at, batch))
            if p == enter:
                at, batch = leaves, batch + n
        return pd.DataFrame(out, columns=["_group", "_block", "_enter", "_batch"])

    def mark(g: pd.DataFrame) -> pd.DataFrame:
        g, begin, stop, end = read(g)
        own, pos, starts = g["_own"].to_numpy(), g["pos"].to_numpy(), np.zeros(len(g), dtype=np.int64)
        to, mine, found = end.tolist(), own.tolist(), []
        for at in np.flatnonzero(own & (pos == g["_enter"].to_numpy())).tolist():
            until = int(stop[at])
            while at < until and mine[at]:  # a step a batch
                found.append(at)
                at = to[at]
        starts[found] = 1
        made = np.cumsum(starts)
        batch = g["_batch"].to_numpy() - 1 + made - (made - starts)[begin]
        return pd.DataFrame({"_group": g["_group"].to_numpy()[own], "pos": pos[own], "batch": batch[own]})

    table = with_more.groupBy(call("_group", "_block")).applyInPandas(chain, "_group long, _block long, pos long, leaves long, n long")
    entries = cut(table.groupBy(call("_group")).applyInPandas(walk, "_group long, _block long, _enter long, _batch long"), "entries")
    marked = with_more.join(entries, ["_group", "_block"]).groupBy(call("_group", "_block")).applyInPandas(mark, "_group long, pos long, batch long")
    return t.join(marked, ["_group", "pos"]).select(*columns, "batch")
