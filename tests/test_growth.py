"""What must not grow faster than the input: rows held at once, pairs met, work a file."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F


def test_block_index_is_read_few_rows_at_once(spark, tmp_path):
    from sparkloom.llm import lexical

    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 50).cast("string")).alias("text"))
    index = lexical.build_index(docs)
    sizes = [m.row_group(i).num_rows for f in index.blocks.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(sizes) == 141 and max(sizes) * 64 <= 2048


def test_wishes_of_any_number_are_not_sent_to_every_executor(spark):
    from sparkloom.operators import jobs

    n = spark.range(3_000_000).select(F.col("id").alias("scenario"), F.lit("a").alias("preferred"), F.lit("b").alias("over"))
    results = n.select("scenario", F.lit(1).alias("rank"), F.lit("xa").alias("id"))
    assert "Broadcast" not in jobs.preferred_over(results, n)._jdf.queryExecution().executedPlan().toString()


def _met(asked, ranges):
    out = {}
    for f, a, b in set(asked):
        hit = [(e - s, i) for i, g, s, e in ranges if g == f and a <= e and s <= b]
        if hit:
            out[f, a, b] = min(hit)[1]
    return out


def test_overlaps_meet_no_more_rows_than_there_are(spark):
    import random

    from sparkloom.operators import citations

    rnd = random.Random(3)
    span = lambda: (a := rnd.choice([rnd.randint(0, 90), rnd.randint(0, 5000), rnd.randint(0, 10**6)]), a + rnd.choice([0, 3, 40, 700, 90_000]) - 2 * (rnd.random() < 0.1))
    ranges = [(f"e{i:03}", f"f{i % 3}", *span()) for i in range(400)]
    asked = [(f"f{i % 4}", *span()) for i in range(400)]
    cited = spark.createDataFrame([(i, f"r{i}", *x) for i, x in enumerate(asked)], "answer_id long, raw string, file_path string, start_line int, end_line int")
    ents = spark.createDataFrame(ranges, "id string, file_path string, start_line long, end_line long")
    got = citations.overlapping(cited, ents)
    assert got.columns == [*cited.columns, "entity_id"]
    want = _met(asked, ranges)
    assert {(r["answer_id"], r["entity_id"]) for r in got.collect()} == {(i, want[x]) for i, x in enumerate(asked) if x in want}
    # Many citations and entities of the same few lines: pairs of them would be 25 million.
    n = spark.range(5000)
    hot = n.select(F.col("id").alias("answer_id"), F.lit("r").alias("raw"), F.lit("f").alias("file_path"), (F.col("id") % 40).cast("int").alias("start_line"), (F.col("id") % 40 + 9).cast("int").alias("end_line"))
    both = citations.overlapping(hot, n.select(F.col("id").cast("string").alias("id"), F.lit("f").alias("file_path"), F.lit(5).alias("start_line"), F.lit(30).alias("end_line")))
    assert both.count() == 5000 - 125 * 9
    assert _most_joined(both) <= 100_000


def _most_joined(df):
    """The most rows that a join of the plan has given."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    df._jdf.queryExecution().toRdd().count()
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_work_a_file_does_not_grow_with_its_square(monkeypatch):
    import ast
    import time

    from sparkloom.operators import extract, extract_ts

    # A file's text is not split anew for each of its variables: lines that end in any way, and characters of several bytes.
    text = "é = 'ü'\r\nA = [1,\n  'ö']; B = {2: 'ß'}\rC = f(\n  3)\n\x0cD = (4 + 5)\n"
    want = {s.targets[0].id: ast.get_source_segment(text, s) for s in ast.parse(text).body}
    monkeypatch.setattr(ast, "get_source_segment", None)
    got = {r["name"]: r["source"] for r in extract._Python("r", "a.py", text, "py.a").run() if r.get("type") == "variable"}
    assert got == {k: want[k] for k in "ABCD"}

    def seconds(run, n):
        at = time.process_time()
        assert len(run(n)) > n
        return time.process_time() - at

    def python(n):
        return extract._Python("r", "a.py", "".join(f"class S{i}:\n    X = g()\nf{i}()\n" for i in range(n)), "py.a").run()

    def typescript(n):
        return extract_ts._facts("r", "a.ts", "".join(f"/** T. */\nexport class T{i} {{\n  a() {{ return m(1); }}\n}}\n" for i in range(n)), "ts.a")

    for run in (python, typescript):
        assert seconds(run, 8000) < 20 * seconds(run, 1000)  # 64 times if it grew with the square


def test_sites_of_a_module_do_not_meet_all_its_children(spark):
    from sparkloom.operators import extract, resolve

    text = "class A:\n    def f(self):\n        x = A()\n" + "".join(f"def g{i}():\n    y = A()\n" for i in range(300)) + "z = A()\n"
    facts = extract.python_facts(spark.createDataFrame([("r", "a.py", text)], "repo_id string, file_path string, content string")).cache()
    child = F.col("type") == "function"  # as if all of them stood on the same lines
    e = extract.entities(facts).withColumns({"start_line": F.when(child, 1).otherwise(F.col("start_line")), "end_line": F.when(child, 1000).otherwise(F.col("end_line"))}).cache()
    found = resolve.symbols(facts, e)
    got = resolve.instantiates(facts, e, resolve.names(found, e))
    assert {(r["source_id"], r["target_id"]) for r in got.collect()} == {(f"py.a.g{i}", "py.a.A") for i in range(300)}
    assert _most_joined(got) <= 5_000  # 90 000 pairs of sites and children


def test_queries_of_a_cell_are_answered_together(spark):
    import time

    import numpy as np

    from sparkloom.operators import vector_index
    from sparkloom.sources.tables import place

    v = np.random.default_rng(2).normal(size=(4000, 16))  # no clusters, so nothing can be skipped
    v[7::1000] = v[7]  # and copies, whose ties go to the lesser id
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(4).cache()
    index = vector_index.build(rows, place(spark, "index"), cells=100)

    def seconds(asked):
        at = time.time()
        got = vector_index.search(spark, index, asked, 5, others=True).collect()
        return time.time() - at, got

    seconds(rows.filter("id % 40 = 1"))  # compiled and read once
    few, _ = seconds(rows.filter("id % 40 = 0"))
    all_, got = seconds(rows)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -9)
    want = {(q, r + 1): int(i) for q in range(len(v)) for r, i in enumerate(np.lexsort((np.arange(len(v)), -score[q]))[:5])}
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want
    assert all_ < 2 * few + 2  # a step a query and cell would be 400 000


def test_chunks_of_many_texts_are_no_groups_of_lines(spark):
    from sparkloom.operators import retrieval

    texts = [(i, "".join(f"{'x' * (i * j % 50)}\n" for j in range(i % 40)) + "end" * (i % 3), None if i % 2 else "k") for i in range(2000)] + [(None, None, "k"), (None, "a\r\nb ", None)]
    files = spark.createDataFrame(texts, "id int, t string, k string")
    made = retrieval.source_chunks(files, ["k", "id"], "t", 25)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan  # a group of lines a text was three calls of Python each
    got, want = {(r["k"], r["id"], r["chunk"]): (r["total_chunks"], r["first_line"], r["last_line"], r["chars"], r["text"]) for r in made.collect()}, {}
    for i, t, k in texts:
        chunks, first = [], 1
        for n, line in enumerate((t or "").splitlines(keepends=True), 1):
            if chunks and len(chunks[-1][1]) + len(line) <= 100:
                chunks[-1] = (n, chunks[-1][1] + line)
            else:
                chunks.append((n, line))
        for c, (last, text) in enumerate(chunks):
            want[k, i, c] = (len(chunks), first, last, len(text), text)
            first = last + 1
    assert got == want and made.count() == len(want)


def test_files_over_the_budget_are_no_groups_of_lines(spark):
    from sparkloom.operators import retrieval

    files = spark.range(600).select(F.lit("r").alias("repo"), F.col("id").alias("path"), F.expr("repeat(repeat('x', 99) || '\\n', if(id % 3 = 0, 2, 50 + id))").alias("t"))
    made = retrieval.file_batches(files, "repo", "path", "t", 3000, 2000, 400)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1  # of the packed files only
    got = {r["kind"]: (r["n"], r["tokens"]) for r in made.groupBy("kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    big = [50 + i for i in range(600) if i % 3]  # lines of 100 characters, 40 a chunk; 1250 tokens and more
    assert got == {"packed": (200, 200 * 50), "chunked": (sum(-(-n // 40) for n in big), sum(25 * n for n in big))}


def test_small_groups_of_batches_share_calls_of_python(spark):
    import time

    from sparkloom.operators import ordered

    # Numbers of groups beyond what a double holds, and nulls among them: groups of one call are not mixed up.
    rows = spark.range(24_000).select(F.col("id").alias("path"), (F.col("id") % 7 + 1).alias("n"), (F.col("id") % 3).alias("m"))

    def seconds(groups):
        group = F.when(F.col("path") % groups != 5, F.lit(2**53) + F.col("path") % groups)
        at = time.time()
        got = ordered.batches(rows.withColumns({"repo": group, "kind": F.lit(None).cast("string")}), ["repo", "kind"], ["path"], {"n": 40, "m": 9}).collect()
        return time.time() - at, got

    seconds(20)  # compiled once
    few, some = seconds(20)
    many, got = seconds(8000)
    for made in (some, got):
        assert len(made) == 24_000
        groups = {}
        for r in sorted(made, key=lambda r: r["path"]):
            groups.setdefault(r["repo"], []).append((r["n"], r["m"], r["batch"]))
        for g in groups.values():
            used, batch = (0, 0), 0
            for n, m, b in g:
                if used != (0, 0) and (used[0] + n > 40 or used[1] + m > 9):
                    used, batch = (0, 0), batch + 1
                used = (used[0] + n, used[1] + m)
                assert b == batch
    assert len(groups) == 8000
    assert many < 2 * few + 3  # three calls a group would be 24 000
