"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

The incidence matrix has a row per distinct n-gram set (documents with equal sets are
one node) and a column per n-gram. Two sets of sizes a <= b can only reach the
threshold t if a >= t b and if they meet among the first n - ceil(t n) + 1 n-grams of
each in one order of all n-grams; only these columns are multiplied. The order puts
n-grams that many nodes hold last, so that shared passages bring few nodes together.
Blocks of columns are multiplied in tasks that add up overlap counts of pairs and drop
pairs whose sizes are too far apart; summed counts below the bound that sizes and the
rest of the n-grams leave are dropped too. What remains is checked on whole texts.

Columns of frequent n-grams longer than ``long_column`` nodes do not emit their pairs. A
first pass links each node to a few candidates only (in a long column, to the node with
most frequent n-grams among those of its size); after connected components, nodes whose
n-grams are frequent ones nearly all and that meet others of another component are
multiplied block by block with their whole sets. A task holds two blocks of bounded size
and hands out no more links than it has nodes, so a group of copies costs about one check
per copy, no group meets in one task, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import drop
from .common import NO_ID, row_id, stored, table

#: Broadcast sides have at most this many rows of two or three longs; beyond, they are shuffled.
BROADCAST_ROWS = 400_000
_LOWER = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it
    is shorter; empty without words."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=_U, count=len(found))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=_U)
    for i in range(k):
        out = _stir(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    """A 63-bit name of a set of shingles; 0 for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        mixed = np.array([s.sum(dtype=_U) + _U(len(s)), _stir(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)], dtype=_U)
        return int(_stir(_stir(mixed[:1]) * _U(3) + mixed[1:])[0] >> _U(1)) or 1


def prefix_len(n, percent: int):
    """How many n-grams of a set of n another set at the threshold must meet one of."""
    return n - (percent * n + 99) // 100 + 1


def required(a, b, percent: int):
    """Least overlap of sets of sizes a and b at the threshold."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=_U)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _features(docs: DataFrame, n: int, percent: int, whole: bool) -> DataFrame:
    """_id, _th, node, n and low: the least hashes of the set, all of them with ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                b = batch.slice(lo, 512)
                sets = [shingles(t, n) for t in b.column(2).to_pylist()]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                take = size if whole else np.minimum(size, prefix_len(size, percent) * 3 // 2 + 8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(size), _lists([s[:k] for s, k in zip(sets, take)])],
                    names=["_id", "_th", "node", "n", "low"],
                )

    return docs.select("_id", "_th", "text").mapInArrow(run, "_id long, _th long, node long, n long, low array<long>")


_ENTRY = ["s", "node", "n", "k", "q", "h", "f"]
_ENTRY_TYPE = ", ".join(f"{x} long" for x in _ENTRY)


def _index(rows: DataFrame, percent: int) -> DataFrame:
    """Entries of the columns to multiply: s, node, n, k (n-grams of the node in the index),
    q (those of them that are not frequent), h (its frequent n-grams) and f (1 if s is frequent).

    Rows are node, n, low and hot (those of low that are frequent). The index of a node
    is the beginning of its set, frequent ones last. Where low has too few others to
    tell, the one entry that comes has k = 0: the whole set is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            s, at, used, rare, many, flag = [], [], [], [], [], []
            for i, (low, hot) in enumerate(zip(b.column(2), b.column(3))):
                a = low.values.to_numpy()
                is_hot = np.isin(a, hot.values.to_numpy()) if hot.is_valid and len(hot) else np.zeros(len(a), dtype=bool)
                k, cold = int(prefix_len(sizes[i], percent)), int((~is_hot).sum())
                h = int(sizes[i])
                if len(a) == sizes[i]:
                    h -= cold
                elif cold < k:
                    k = 0
                pick = np.argsort(is_hot, kind="stable")[: max(1, k)]
                s.append(a[pick])
                flag.append(is_hot[pick].astype(np.int64))
                at.append(np.full(len(pick), i))
                used.append(np.full(len(pick), k))
                rare.append(np.full(len(pick), int((~is_hot[pick]).sum())))
                many.append(np.full(len(pick), h))
            if s:
                i = np.concatenate(at)
                cols = [np.concatenate(s), nodes[i], sizes[i], *(np.concatenate(x).astype(np.int64) for x in (used, rare, many, flag))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_ENTRY)

    return rows.select("node", "n", "low", "hot").mapInArrow(run, _ENTRY_TYPE)


class _Pairs:
    """Adds up the counts of pairs inside a task and hands them out."""

    def __init__(self, most: int = 400_000):
        self.rows, self.held, self.most = [], 0, most

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            self.rows.append(np.stack(cols, 1))
            self.held += len(cols[0])
        if self.held >= self.most:
            yield from self.out(False)

    def out(self, end: bool = True) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        x = np.concatenate(self.rows)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        first = np.nonzero(np.r_[True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])])[0]
        c = np.add.reduceat(x[:, -1], first)
        x = x[first]
        x[:, -1] = c
        self.rows, self.held = [x], len(x)
        if end or self.held >= self.most // 2:
            for lo in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[lo : lo + 50_000, j])) for j in range(7)], names=_PAIR)
            self.rows, self.held = [], 0


_PAIR = ["a", "b", "na", "nb", "ka", "kb", "c"]
_PAIR_TYPE = ", ".join(f"{x} long" for x in _PAIR)


def _near(s, n, percent: int, reach: int):
    """Index pairs (i, j) of one column whose sizes are near enough; sorted by (s, n)."""
    idx = np.arange(len(s))
    for d in range(1, reach):
        idx = idx[: np.searchsorted(idx, len(s) - d)]
        if not len(idx):
            return
        idx = idx[(s[idx] == s[idx + d]) & (100 * n[idx] >= percent * n[idx + d])]
        if not len(idx):
            return
        yield idx, idx + d


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches cut so that no column (run of equal s) is split."""
    rest = None
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        if not len(cols[0]):
            continue
        if rest is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None:
        yield rest


def _multiply(index: DataFrame, percent: int) -> DataFrame:
    """Pairs with counts, of columns that few nodes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for s, node, n, q in _runs(batches):
            first = np.nonzero(np.r_[True, s[1:] != s[:-1]])[0]
            length = np.diff(np.r_[first, len(s)])
            for i, j in _near(s, n, percent, int(length.max(initial=1))):
                lo, hi = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                ok = node[lo] != node[hi]
                lo, hi = lo[ok], hi[ok]
                yield from pairs.add(node[lo], node[hi], n[lo], n[hi], q[lo], q[hi], np.ones(len(lo), dtype=np.int64))
        yield from pairs.out()

    return index.select("s", "node", "n", "q").repartition("s").sortWithinPartitions("s", "n", "node").mapInArrow(run, _PAIR_TYPE)


def _class(n, percent: int):
    """Number of the size class: sets at the threshold are at most two apart."""
    return F.floor(F.log(n) / F.lit(np.log(100 / percent) / 2 * (1 + 1e-9))).cast("int")


def _stars(long: DataFrame, percent: int) -> DataFrame:
    """(a, b, c): entries of long columns (s, node, n, h, cls) with the pivots of their size
    class and its neighbours, and in how many columns they meet. The pivot of a column and
    class is the node with most frequent n-grams, found by aggregation."""
    pivot = F.max_by(F.struct("node", "n", "h"), F.struct(F.col("h"), -F.col("node"))).alias("p")
    pivots = stored(long.groupBy("s", "cls").agg(pivot), "pivots")
    each = long.select("s", "node", "n", "h", F.explode(F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)).alias("cls"))
    met = each.join(_sized(pivots), ["s", "cls"]).filter("node <> p.node")
    a, b = F.col("n"), F.col("p.n")
    least = F.floor((percent * (a + b) + 99 + percent) / (100 + percent))
    met = met.filter((F.least("h", "p.h") >= least) & (100 * F.least(a, b) >= percent * F.greatest(a, b)))
    return met.groupBy(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).agg(F.count("*").alias("c"))


def _joined(sets: list[np.ndarray], size: np.ndarray, label: np.ndarray, role: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Linked pairs (i, j) of two blocks (role 0 and 1) that join labels not joined before: a forest, so fewer than there are sets.
    A role of 2 is in both blocks."""
    left, right = np.nonzero(role != 1)[0], np.nonzero(role != 0)[0]
    if not len(left) or not len(right):
        return
    flat = np.concatenate([sets[j] for j in right])
    of = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for i in left:
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(of[at], minlength=len(right))
        for j in right[np.nonzero((100 * both >= percent * (size[i] + size[right] - both)) & (label[right] != label[i]))[0]]:
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                yield int(i), int(j)


def _multiply_apart(nodes: DataFrame, sets: DataFrame, percent: int, most: int = 32_000) -> DataFrame:
    """Links (a, b) between nodes (family, node, n, label) of one family and different labels, by their whole sets (node, low).

    Nodes are dealt to blocks by size class and hash, apart for the family's most
    frequent label, whose blocks do not meet; a block has about ``most`` n-grams.
    """
    nodes = nodes.withColumn("cls", _class(F.col("n"), percent))
    main = nodes.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("main"))
    nodes = nodes.join(_sized(stored(main, "main")), "family").withColumn("rest", (F.col("label") != F.col("main")).cast("int"))
    nodes = stored(nodes.select("family", "node", "label", "cls", "rest", "n"), "nodes_apart")
    part = ["family", "rest", "cls"]
    parts = nodes.groupBy(*part).agg(F.ceil(F.sum("n") / most).cast("int").alias("m"))
    parts = stored(parts, "parts")
    x = parts.filter("rest = 1").select("family", F.col("cls").alias("cls_x"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("at_x"))
    y = parts.select("family", F.col("rest").alias("rest_y"), F.col("cls").alias("cls_y"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("at_y"))
    near = F.abs(F.col("cls_x") - F.col("cls_y")) <= 2
    once = (F.col("rest_y") == 0) | (F.struct("cls_x", "at_x") <= F.struct("cls_y", "at_y"))
    tasks = x.join(y, "family").filter(near & once).withColumn("task", F.xxhash64("family", "cls_x", "at_x", "rest_y", "cls_y", "at_y"))
    same = (F.col("rest_y") == 1) & (F.col("cls_x") == F.col("cls_y")) & (F.col("at_x") == F.col("at_y"))
    first = tasks.select("task", "family", F.lit(1).alias("rest"), F.col("cls_x").alias("cls"), F.col("at_x").alias("at"), F.when(same, 2).otherwise(0).alias("role"))
    second = tasks.filter(~same).select("task", "family", F.col("rest_y").alias("rest"), F.col("cls_y").alias("cls"), F.col("at_y").alias("at"), F.lit(1).alias("role"))
    dealt = nodes.join(_sized(parts), part).withColumn("at", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    dealt = dealt.join(_sized(stored(first.unionByName(second), "tasks")), [*part, "at"]).select("task", "role", "node", "label")
    rows = dealt.join(sets.select("node", "low"), "node").select("task", "role", "node", "label", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            role, node, label = (np.array([r[k] for r in held]) for k in (1, 2, 3))
            found = [sorted((int(node[i]), int(node[j]))) for i, j in _joined([r[4] for r in held], np.array([len(r[4]) for r in held]), label, role, percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for b in batches:
            task, role, node, label = (b.column(i).to_numpy() for i in range(4))
            for i, low in enumerate(b.column(4)):
                if held and held[0][0] != task[i]:
                    yield from out()
                    held.clear()
                held.append((task[i], role[i], node[i], label[i], low.values.to_numpy().astype(np.int64)))
        if held:
            yield from out()

    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "a long, b long")


def _sized(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if it is proven to be small."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, n: int, percent: int, per_task: int = 500) -> DataFrame:
    """Those of pairs (a, b) whose whole texts are at the threshold.

    Each b goes to a task with its a; an a with many b is copied to several tasks.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("m"))
    shares = F.ceil(F.col("m") / per_task).cast("int")
    many = pairs.join(_sized(counts.filter(F.col("m") > per_task)), "a", "left")
    many = many.select("a", "b", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), shares)).cast("int").alias("salt"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.when(F.col("m") > per_task, shares - 1).otherwise(0))).alias("salt"))
    need = many.select("a", "salt", F.col("b").alias("node")).unionByName(heads.select("a", "salt", F.col("a").alias("node")))
    need = stored(need.join(names, "node").select("a", "salt", "node", "_id"), "need")
    rows = docs.join(_sized(need), "_id").select("a", "salt", (F.col("node") != F.col("a")).cast("int").alias("role"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            for lo in range(0, len(batch), 512):
                b = batch.slice(lo, 512)
                a, salt, role, node = (b.column(i).to_numpy() for i in range(4))
                found: list[tuple[int, int]] = []
                for i, text in enumerate(b.column(4).to_pylist()):
                    s = shingles(text, n)
                    if node_of(s) != node[i]:
                        continue  # another text under the same id
                    if role[i] == 0:
                        at, head = (a[i], salt[i]), s
                    elif at == (a[i], salt[i]):
                        both = len(np.intersect1d(head, s, assume_unique=True))
                        if 100 * both >= percent * (len(head) + len(s) - both):
                            found.append((int(a[i]), int(node[i])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): the least node that each linked node reaches.

    Large-star and small-star rounds; no neighbourhood is ever collected, and the work
    of a round is in proportion to the links left.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    n = edges.count()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after, before = stored(small, "edges"), n
        n = after.count()
        if n == before and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            drop(after)
            break
        drop(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, long_column: int = 32
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    A text's set is that of its n-word shingles after lower-casing A-Z (the whole
    sequence if it is shorter). Texts link when 100 * intersection >= percent * union;
    component_id is the least id that links reach. Null and empty texts have empty sets
    and link with nothing. Repeated rows have equal sets and so one component; a null id
    is the least of all and stays null. Rows with one id and several texts are one
    document each, and take the least id of their own component. Other columns are not
    read, so their names cannot clash; an empty table gives no rows.
    """
    found = labelled_rows(docs, id_col, text_col, n, percent, long_column)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(null("_id").alias(id_col), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, long_column: int = 32) -> DataFrame:
    """What jaccard_components gives, as _id and _th of common.row_id, n, component and
    label; unlike component, label differs between components that have their least id
    in common. It is null for empty sets.

    Very long texts are hashed whole; a task holds the sets of a bounded number of rows
    (512, or two blocks of about 32 000 n-grams and one text more)."""
    named = docs.select(*row_id(id_col, text_col), F.col(text_col).alias("text"))
    feats = stored(_features(named, n, percent, False), "features")
    full = feats.filter("n > 0")
    names = stored(full.groupBy("node").agg(F.min("_id").alias("_id"), F.count("*").alias("copies")), "nodes")
    # Of each set's documents one stands for all; the others leave.
    others = full.select("_id", "node").join(names.filter("copies > 1").withColumnRenamed("_id", "least"), "node").filter("_id > least").select("_id", "node")
    reps = full.join(_sized(others), ["_id", "node"], "left_anti").select("node", "n", "low")
    # Frequent n-grams: by the least hashes of all sets; and, for nodes of which those tell
    # too little, by their whole sets. The order of n-grams only needs to be one and the
    # same for all nodes, so what is counted bears on the work, not on the result.
    count = lambda rows: rows.select(F.explode("low").alias("s")).groupBy("s").count().filter(F.col("count") > long_column).select("s")

    def with_hot(rows: DataFrame, hot: DataFrame) -> DataFrame:
        of = rows.select("node", F.explode("low").alias("s")).join(_sized(hot), "s").groupBy("node").agg(F.collect_set("s").alias("hot"))
        return rows.join(_sized(stored(of, "frequent_of")), "node", "left").select("node", "n", "low", "hot")

    names_id = names.select("node", "_id")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Whole sets of ``nodes``."""
        deep = stored(nodes.join(names_id, "node").select("_id", "node"), "deep")
        rows = named.join(_sized(deep.select("_id").distinct()), "_id", "left_semi")
        rows = _features(rows, n, percent, True).join(_sized(deep), ["_id", "node"], "left_semi")
        return stored(rows.dropDuplicates(["node"]).select("node", "n", "low"), "whole")

    hot = stored(count(reps), "frequent")
    index = stored(_index(with_hot(reps, hot), percent), "index")
    wide = sets_of(index.filter("k = 0").select("node"))
    more = stored(count(wide).join(_sized(hot), "s", "left_anti"), "frequent")
    if not more.isEmpty():
        hot = hot.unionByName(more)
        drop(index, wide)
        index = stored(_index(with_hot(reps, hot), percent), "index")
        wide = sets_of(index.filter("k = 0").select("node"))
    first, index = index, stored(index.filter("k > 0").unionByName(_index(with_hot(wide, hot), percent)), "index")
    drop(first, wide)
    # Frequent columns that many nodes hold, and the others, which few do.
    columns = index.filter("f = 1").groupBy("s").count().filter(F.col("count") > long_column).select("s")
    columns = _sized(stored(columns, "columns"))
    frequent = index.filter("f = 1")
    long = frequent.join(columns, "s", "left_semi").select("s", "node", "n", "h", _class(F.col("n"), percent).alias("cls"))
    long = stored(long, "long")
    few = index.filter("f = 0").unionByName(frequent.join(columns, "s", "left_anti"))
    counted = stored(_multiply(few, percent), "product")
    drop(index)

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs whose counts can still reach the threshold. What is not counted lies behind
        the first ka and kb n-grams of the two: those that are not frequent in what short
        columns counted, the whole index in what all columns did."""
        c = pairs.groupBy("a", "b", "na", "nb").agg(F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.sum("c").alias("c"))
        need = F.floor((percent * (F.col("na") + F.col("nb")) + 99 + percent) / (100 + percent))
        return c.filter(F.col("c") + F.greatest(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) >= need)

    short = stored(bounded(counted).select("a", "b"), "candidates")
    drop(counted)
    # First one candidate of short columns for each node, and the pivots it meets most often.
    w = W.partitionBy("b").orderBy("c", "a")
    stars = stored(_stars(long, percent).select("a", "b", (-F.col("c")).alias("c")), "stars")
    stars = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    stars = stars.withColumn("r", F.row_number().over(w)).filter("r <= 3").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    one = short.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(stars).distinct()
    one = stored(one, "first")
    links = stored(_verified(one, named, names_id, n, percent), "links")
    labels = stored(components(links), "labels")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends have different labels, _a and _b."""
        for x in ("a", "b"):
            label = labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
            pairs = pairs.join(label, x, "left").withColumn(f"_{x}", F.coalesce(f"_{x}", x))
        return pairs.filter("_a <> _b")

    # Nodes that meet in long columns only can be at the threshold if frequent n-grams are
    # nearly all they have: any others are in the index, so a pair that shares one met there.
    entries = long.filter(100 * F.col("h") >= percent * F.col("n")).select("s", "node", "n")
    entries = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = entries.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("least")).filter("lo < hi").select("s", "least")
    entries = stored(entries.join(_sized(stored(mixed, "mixed")), "s").select("node", "n", "label", "least").distinct(), "mixed_entries")
    drop(long)
    more = stored(_verified(stored(apart(short).select("a", "b").join(one, ["a", "b"], "left_anti"), "second"), named, names_id, n, percent), "links")
    if not entries.isEmpty():
        family = components(entries.select("node", "least"), "node", "least").withColumnRenamed("label", "family")
        nodes = entries.select("node", "n", "label").distinct().join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
        nodes = stored(nodes, "families")
        more = more.unionByName(stored(_multiply_apart(nodes, sets_of(nodes.select("node")), percent), "links"))
    if not more.isEmpty():
        # Only labels that later links join are looked at again, not all links.
        top = components(apart(more).select("_a", "_b"), "_a", "_b")
        below = labels.join(_sized(top.select(F.col("node").alias("label"), F.col("label").alias("_top"))), "label", "left")
        labels = stored(below.select("node", F.coalesce("_top", "label").alias("label")).unionByName(top), "labels")

    comp = names.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = comp.groupBy("label").agg(F.min("_id").alias("component"))
    of = comp.join(least, "label").select("node", "label", "component")
    out = feats.select("_id", "_th", "node", "n").join(of, "node", "left")
    return out.select("_id", "_th", "n", F.coalesce("component", "_id").alias("component"), "label")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
