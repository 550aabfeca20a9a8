"""Operators against plain Python on small random rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import accounts, answers, citations, memory, ordered, retrieval
from sparkloom.sources import tables
from sparkloom.streaming import quota


def plain_batches(rows, mosts):
    batch, used, out = 0, None, []
    for sizes in rows:
        if used and any(u + s > m for u, s, m in zip(used, sizes, mosts)):
            batch, used = batch + 1, None
        used = [u + s for u, s in zip(used or [0] * len(mosts), sizes)]
        out.append(batch)
    return out


@pytest.mark.parametrize(("mosts", "hi", "block"), [((10,), 12, 2), ((50, 4), 20, 1), ((1,), 3, 3), ((1000,), 5, 128), ((30, 5, 17), 40, 2), ((100_000, 5), 700, 128)])
def test_batches_equal_a_fold(spark, monkeypatch, mosts, hi, block):
    monkeypatch.setattr(ordered, "BLOCK_BATCHES", block)
    monkeypatch.setattr(ordered.running, "__defaults__", (37,))  # rows of a range
    rng = random.Random(hi)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, *(rng.randint(1 if j == 0 else 0, hi if j == 0 else 3) for j in range(len(mosts)))) for i in range(400)]
    rows += [(None, i, *[1] * len(mosts)) for i in range(9)] + [("one", 0, *[hi * 100] * len(mosts))]
    names = [f"n{j}" for j in range(len(mosts))]
    got = ordered.batches(spark.createDataFrame(rows, "g string, i int, " + ", ".join(f"{n} long" for n in names)), ["g"], ["i"], dict(zip(names, mosts))).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r["i"], r["batch"], *[r[n] for n in names]) for r in got if r["g"] == g)
        assert [m[1] for m in mine] == plain_batches([m[2:] for m in mine], mosts)


def test_running_values_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, 1, 5, -2])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = {r["i"]: (r["pos"], r["s"]) for r in ordered.running(df, ["g"], ["i"], {"s": F.col("v")}, 23).collect()}
    near = {r["i"]: (r["before"], r["after"]) for r in ordered.around(df, ["g"], "i", F.col("v"), 23).collect()}
    for g, i, _ in rows:
        mine = [(j, v) for h, j, v in rows if h == g]
        earlier, later = [v for j, v in mine if j <= i], [v for j, v in mine if j >= i]
        assert got[i] == (len(earlier) - 1, sum(v or 0 for v in earlier))
        assert near[i] == (next((v for v in reversed(earlier) if v is not None), None), next((v for v in later if v is not None), None))
    none = df.filter("false")
    assert ordered.running(none, ["g"], ["i"], {}).collect() == [] and ordered.batches(none, ["g"], ["i"], {"v": 5}).collect() == []


def _chunks_of(text, max_chars):
    out, cur, n = [], [], 0
    for line in text.splitlines(keepends=True):
        if n + len(line) > max_chars and cur:
            out.append("".join(cur))
            cur, n = [line], len(line)
        else:
            cur.append(line)
            n += len(line)
    return out + (["".join(cur)] if cur else [])


def test_file_batches_equal_plain_python(spark):
    rng = random.Random(6)
    line = lambda: "x" * rng.choice([0, 1, 30, 200, 900]) + rng.choice(["\n", "\n", "\r\n", "\r", "\u2028", "\x0c"])
    files = [(rng.choice("rs"), f"f{i:03}", "".join(line() for _ in range(rng.choice([0, 1, 3, 40, 90])))) for i in range(60)] + [("r", "long", "y" * 9000), ("s", "none", None)]
    got = retrieval.file_batches(spark.createDataFrame(files, "repo string, path string, t string"), "repo", "path", "t", 3000, 2000, 400).collect()
    want = []
    for repo in "rs":
        packed, small = [], 0
        for _, path, t in sorted(f for f in files if f[0] == repo):
            n = max(1, len(t or "") // 4)
            if n > 1000:
                parts = _chunks_of(t, 4000)
                want += [(repo, path, max(1, len(p) // 4), "chunked", i, len(parts), None) for i, p in enumerate(parts)]
            elif n < 300 and t is not None:
                packed.append((path, n))
            elif t is not None:
                want.append((repo, path, n, "single", 0, 1, None))
        for (path, n), b in zip(packed, plain_batches([(n, 400) for _, n in packed], (1000, 800))):
            want.append((repo, path, n, "packed", 0, 1, b))
    key = lambda r: tuple(map(str, r))
    columns = ["repo", "path", "tokens", "kind", "chunk", "total_chunks", "batch"]
    assert sorted((tuple(r[c] for c in columns) for r in got if r["path"] != "none"), key=key) == sorted(want, key=key)
    text = {(r["repo"], r["path"], r["chunk"]): r["text"] for r in retrieval.source_chunks(spark.createDataFrame(files, "repo string, path string, t string"), ["repo", "path"], "t", 100).collect()}
    for repo, path, t in files:
        parts = _chunks_of(t or "", 400)
        assert [text[repo, path, i] for i in range(len(parts))] == parts and (repo, path, len(parts)) not in text


def test_sliding_count_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randint(0, 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    for r in memory.sliding_count(df, "k", "ts", 60).collect():
        assert r["recent"] == sum(1 for _, k, s in rows if k == r["k"] and r["s"] - 60 < s < r["s"])


def test_citations_meet_entities_by_bins_and_neighbours(spark):
    rng = random.Random(7)
    ents = [(f"e{i}", rng.choice(["f", "g"]), (a := rng.randint(1, 900)), a + rng.choice([0, 3, 70, 500])) for i in range(60)]
    cites = [(i, f"r{i}", rng.choice(["f", "g", "h"]), (a := rng.randint(1, 1500)), a + rng.choice([0, 5, 200])) for i in range(80)]
    e = spark.createDataFrame(ents, "id string, file_path string, start_line int, end_line int")
    c = spark.createDataFrame(cites, "answer_id int, raw string, file_path string, start_line int, end_line int")
    over = {r["answer_id"]: r["entity_id"] for r in citations.overlapping(c, e).collect()}
    near = {r["answer_id"]: (r["distance"], r["entity_id"]) for r in citations.nearest(c, e).collect()}
    for i, _, f, s, t in cites:
        hit = [(b - a, x) for x, g, a, b in ents if g == f and s <= b and a <= t]
        assert over.get(i) == (min(hit)[1] if hit else None)
        at = [(min(abs(a - s), abs(b - s)), x) for x, g, a, b in ents if g == f]
        assert near.get(i) == (min(at) if at else None)


def test_quota_marks_in_a_stream(spark, tmp_path):
    rows = [(1, "a", "ok", 10), (2, "a", "429", 20), (3, "a", "ok", 30), (4, "b", "ok", 40), (5, "a", "ok", 86_400 + 5), (6, "b", "429", 50), (7, "b", "ok", 60)]
    df = spark.createDataFrame(rows, "id long, k string, said string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = quota.drain(quota.exhausted(stream, "k", "ts", "id", F.col("said") == "429"), "marks")
    assert {r["id"]: r["exhausted"] for r in out.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    batch = {r["id"]: r["exhausted"] for r in memory.exhausted(df, "k", "ts", F.col("said") == "429").collect()}
    assert batch == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    log = quota.drain(quota.sliding_log(stream, "k", "ts", "id"), "sliding")
    assert {r["id"]: r["recent"] for r in log.collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 1, 7: 2}


def test_first_object_and_retry(spark):
    texts = [("x {bad {\"a\": {\"status\": 1}} y",), ("{\"s\": 1} {\"status\": {\"b\": [1, 2]}}",), (None,), ("",), ("{" * 300,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(answers.first_object(F.col("t"), "status")).collect()]
    assert got == ['{"status": 1}', '{"status": {"b": [1, 2]}}', None, None, None]
    now = F.timestamp_seconds(F.lit(100))
    due = spark.range(1).select(memory.retry_due(now, F.timestamp_seconds(F.lit(80))), memory.retry_due(now, F.timestamp_seconds(F.lit(70))), memory.retry_due(now, F.lit(None).cast("timestamp"))).first()
    assert tuple(due) == (False, True, True)
    left = accounts.violations(spark.createDataFrame([("x",), (None,), ("user",)], "role string"), {"turn_role": accounts.CHECKS["turn_role"]})
    assert [tuple(r) for r in left.collect()] == [("turn_role", 1)]


def test_scope_deletes_what_was_cut_inside(spark):
    kept = tables.cut(spark.range(3))
    with tables.scope() as keep:
        gone = tables.cut(spark.range(4))
        keep.append(tables.cut(spark.range(5)))
        assert gone.count() == 4
    assert kept.count() == 3 and keep[0].count() == 5
    tables.drop(keep[0])
    assert not os.path.exists(keep[0]._cut_at.removeprefix("file://")) and kept.count() == 3
    left = [p for _, p in tables._made]
    assert any(p in kept.inputFiles()[0] for p in left) and not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
