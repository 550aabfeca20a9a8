"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A
flow routes the words of patterns to the quotas of sources: each pattern offers its
words once for each repetition up to ``max_repeats``, at a cost that rises with the
repetition, and a source takes from the patterns it is in. Only pattern totals reach
the driver. The flow of a pattern then becomes whole repetitions of all its documents
and one more of the first of them in a seeded order, found by two prefix sums (over
buckets of the order, then within the one bucket where the flow ends).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, n_words, stored, table

#: Buckets of the seeded order within a pattern; bounds the rows of one window.
ORDER_BUCKETS = 4096


def quotas(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight; no share is above cap times its size, and what is
    cut off is shared again by weight among the others until none is above."""
    out = [0.0] * len(sizes)
    open_ = [i for i, w in enumerate(weights) if w > 0 and sizes[i] > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(
    patterns: Sequence[tuple[frozenset[int], int]], quota: Sequence[float], max_repeats: int
) -> list[dict[int, int]]:
    """For each pattern, the words that each of its sources takes from it.

    Nodes: patterns, sources, sink. A pattern has one arc of its size for each
    repetition k, at cost k (so costs are convex), and an arc to each of its sources; a
    source has an arc of its quota to the sink. Successive cheapest paths with
    potentials; the flow is the largest there is, at the least cost.
    """
    n_p, n_s = len(patterns), len(quota)
    start, sink = n_p + n_s, n_p + n_s + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(n_p + n_s + 2)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    for p, (_, size) in enumerate(patterns):
        for k in range(max_repeats):
            arc(start, p, int(size), k)
    links = {(p, s): arc(p, n_p + s, max_repeats * int(size), 0) for p, (of, size) in enumerate(patterns) for s in sorted(of)}
    for s, q in enumerate(quota):
        arc(n_p + s, sink, round(q), 0)
    potential = [0] * len(out)
    while True:
        dist, via, heap = [None] * len(out), [0] * len(out), [(0, start)]
        dist[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if cap[e] > 0:
                    y, nd = to[e], d + cost[e] + potential[x] - potential[to[e]]
                    if dist[y] is None or nd < dist[y]:
                        dist[y], via[y] = nd, e
                        heapq.heappush(heap, (nd, y))
        if dist[sink] is None:
            break
        far = max(d for d in dist if d is not None)
        potential = [v + (far if d is None else d) for v, d in zip(potential, dist)]
        push, x = None, sink
        while x != start:
            push = cap[via[x]] if push is None else min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != start:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    flow: list[dict[int, int]] = [{} for _ in patterns]
    for (p, s), e in links.items():
        if cap[e ^ 1]:
            flow[p][s] = cap[e ^ 1]
    return flow


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    weights: Sequence[float] = (1, 2, 3),
    seed: int = 17,
    max_repeats: int = 3,
    id_col: str = "doc_id",
    tie_col: str = "text",
    max_patterns: int = 100_000,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken and repeats (0 to ``max_repeats``).

    ``sources`` is an array of the names a document belongs to (null names allowed; an
    empty or null array is one of a null name); source_size and target are sums over
    the document's sources. Sources by code point, null last, weigh ``weights``, over
    and over; together they get 100 % of all sizes, none above ``max_repeats`` times
    its own. Taken is repeats * size, so a source's words are off its target by less
    than one document for each of its patterns.

    The order within a pattern is a hash of ``seed``, id and text, so reruns agree;
    rows equal in both are taken equally often. Documents of size 0 are taken once (they cost nothing). Null sizes are 0;
    an empty table stays empty; columns of these names are replaced, names that begin
    with ``_m_`` are the operator's own; of very long texts only the hash is used. More than
    ``max_patterns`` patterns raise an error: they are the one thing that the driver
    holds.
    """
    spark = docs.sparkSession
    made = ["size", "source_size", "target", "taken", "repeats"]
    named = F.when(sources.isNull() | (F.size(sources) == 0), F.array(F.lit(None).cast("string"))).otherwise(sources)
    df = docs.withColumns({
        "_m_of": F.sort_array(F.array_distinct(named)),
        "_m_size": F.coalesce(size.cast("long"), F.lit(0).cast("long")),
        "_m_key": F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(tie_col).cast("string"), F.lit("\x00null"))),
    })
    df = df.withColumn("_m_bucket", F.shiftrightunsigned("_m_key", 52).cast("int"))
    # Sizes are worked out once; the sums and the order read these few columns.
    slim = stored(df.select("_m_of", "_m_size", "_m_key", "_m_bucket"), "mixing")
    sums = slim.groupBy("_m_of", "_m_bucket").agg(F.sum("_m_size").alias("n"))
    found = sums.groupBy("_m_of").agg(F.sum("n").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = sorted({s for r in found for s in r["_m_of"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    patterns = [(frozenset(index[s] for s in r["_m_of"]), int(r["n"])) for r in found]
    sizes = [0] * len(names)
    for of, n in patterns:
        for s in of:
            sizes[s] += n
    total = sum(n for _, n in patterns)
    quota = quotas(sizes, [weights[i % len(weights)] for i in range(len(names))], total, max_repeats)
    flow = min_cost_flow(patterns, quota, max_repeats)
    plan = []
    for r, (of, n), f in zip(found, patterns, flow):
        whole, rest = divmod(sum(f.values()), n) if n else (1, 0)
        plan.append((r["_m_of"], sum(sizes[s] for s in of), float(sum(quota[s] for s in of)), int(whole), int(rest)))
    schema = T.StructType([
        T.StructField("_m_of", T.ArrayType(T.StringType())), T.StructField("_m_source", T.LongType()), T.StructField("_m_target", T.DoubleType()),
        T.StructField("_m_whole", T.IntegerType()), T.StructField("_m_rest", T.LongType()),
    ])
    plans = spark.createDataFrame(plan, schema)
    # Where the rest of a pattern ends: (patterns * ORDER_BUCKETS) sums, one window each,
    # then the order of the rows of that one bucket.
    buckets = sums.withColumn("_m_before", F.sum("n").over(W.partitionBy("_m_of").orderBy("_m_bucket")) - F.col("n"))
    edge = buckets.join(plans, "_m_of").filter((F.col("_m_before") <= F.col("_m_rest")) & (F.col("_m_rest") < F.col("_m_before") + F.col("n")))
    edge = edge.select("_m_of", F.col("_m_bucket"), (F.col("_m_rest") - F.col("_m_before")).alias("_m_left"))
    order = W.partitionBy("_m_of").orderBy("_m_key", "_m_size").rowsBetween(W.unboundedPreceding, 0)
    near = slim.join(edge, ["_m_of", "_m_bucket"]).withColumn("_m_upto", F.sum("_m_size").over(order))
    near = near.filter(F.col("_m_upto") - F.col("_m_size") / 2 <= F.col("_m_left"))
    cut = {tuple(r["_m_of"]): r["k"] for r in near.groupBy("_m_of").agg(F.max("_m_key").alias("k")).collect()}
    at = {tuple(r["_m_of"]): r["_m_bucket"] for r in edge.select("_m_of", "_m_bucket").collect()}
    ends = [(*row[:4], at.get(tuple(row[0]), -1), cut.get(tuple(row[0]))) for row in plan]
    schema = T.StructType([*schema.fields[:4], T.StructField("_m_edge", T.IntegerType()), T.StructField("_m_cut", T.LongType())])
    ends = spark.createDataFrame(ends, schema)
    if len(plan) * 200 <= 8 << 20:
        ends = F.broadcast(ends)
    both = df.join(ends, "_m_of")
    last = (F.col("_m_bucket") == F.col("_m_edge")) & F.coalesce(F.col("_m_key") <= F.col("_m_cut"), F.lit(False))
    both = both.withColumn("_m_more", F.when((F.col("_m_bucket") < F.col("_m_edge")) | last, 1).otherwise(0))
    times = F.least(F.lit(max_repeats), F.col("_m_whole") + F.col("_m_more"))
    times = F.when(F.col("_m_size") == 0, F.lit(1)).otherwise(times).cast("int")
    keep = [c for c in docs.columns if c.lower() not in made]
    return both.select(
        *keep, F.col("_m_size").alias("size"), F.col("_m_source").alias("source_size"), F.col("_m_target").alias("target"),
        (times * F.col("_m_size")).cast("long").alias("taken"), times.alias("repeats"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # The text is read for its size and hash alone; neither shuffle carries it.
    small = docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), F.xxhash64(F.coalesce("text", F.lit("\x00null"))).alias("th"))
    out = mix(stored(small, "sizes"), F.array("source"), F.col("n"), tie_col="th")
    return out.select("doc_id", "size", "source_size", "target", "taken")
