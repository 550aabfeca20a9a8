"""Ranges of lines that meet, without a join of all that share a bin.

Lines are cut into blocks of 1, 8, 64, ... lines. A range is covered by few of them, and a
line lies in one of each size. Two ranges meet where one begins inside the other; so of
all ranges on one side, each block keeps what counts least among those that begin in it
and among those it covers, and a range on the other side looks up its own few blocks.
Rows grow with the number of ranges, however many of them lie on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Blocks of one size in a block of the next, and how many sizes there are; a range longer than the largest has several of these.
FAN, SIZES = 8, 6


def _block(level: int, first: Column, end: Column) -> Column:
    """Blocks ``first`` up to before ``end``."""
    made = F.transform(F.sequence(first, end - 1), lambda n: F.struct(F.lit(level).alias("level"), n.alias("n")))
    return F.when(first < end, made).otherwise(F.array().cast("array<struct<level:int,n:bigint>>"))


def around(line: Column) -> Column:
    """The blocks that hold a line, one of each size."""
    return F.array(*[F.struct(F.lit(i).alias("level"), F.floor(line / FAN**i).alias("n")) for i in range(SIZES)])


def cover(start: Column, end: Column) -> Column:
    """The fewest blocks that hold the lines from ``start`` to ``end`` and no others; none if the range is empty."""
    lo = [F.ceil(start / FAN**i) for i in range(SIZES)]
    hi = [F.floor((end + 1) / FAN**i) for i in range(SIZES)]
    parts = []
    for i in range(SIZES - 1):
        left = F.least(hi[i], lo[i + 1] * FAN)
        parts += [_block(i, lo[i], left), _block(i, F.greatest(left, hi[i + 1] * FAN, lo[i]), hi[i])]
    return F.concat(*parts, _block(SIZES - 1, lo[-1], hi[-1]))


def least_met(asked: DataFrame, ranges: DataFrame, keys: list[str], least: str) -> DataFrame:
    """(keys, start_line, end_line, ``least``): for each distinct range of ``asked``, the least ``least`` of all ``ranges`` of its keys that share a line with it.

    Both have (keys, start_line, end_line). A range that ends before it starts meets those
    that hold both its lines; such ranges, which no block covers, are compared with all
    distinct ranges of their keys.
    """
    span = [*keys, "start_line", "end_line"]
    q = asked.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]).filter("start_line is not null and end_line is not null").distinct()
    r = ranges.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")], least).filter("start_line is not null and end_line is not null")
    q, r = cut(q, "lines_asked"), cut(r.groupBy(*span).agg(F.min(least).alias(least)), "lines")
    a, b = F.col("start_line"), F.col("end_line")
    forward = a <= b

    def met(mine: Column, theirs: Column) -> DataFrame:
        best = r.filter(forward).select(*keys, F.explode(theirs).alias("_b"), least).groupBy(*keys, "_b").agg(F.min(least).alias(least))
        return q.filter(forward).select(*span, F.explode(mine).alias("_b")).join(best, [*keys, "_b"]).select(*span, least)

    out = met(cover(a, b), around(a)).unionByName(met(around(a), cover(a, b)))
    other = r.withColumnsRenamed({"start_line": "_s", "end_line": "_e"})
    for mine, theirs in ((~forward, F.lit(True)), (forward, F.col("_e") < F.col("_s"))):
        odd = q.filter(mine).join(other.filter(theirs), keys).filter("start_line <= _e and _s <= end_line")
        out = out.unionByName(odd.select(*span, least))
    return out.groupBy(*span).agg(F.min(least).alias(least))
