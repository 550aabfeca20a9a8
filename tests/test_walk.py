from pyspark.sql import functions as F

from sparkloom.operators import graph, walk


def _data(spark):
    ents = spark.createDataFrame(
        [(f"m{f}", "module", f"m{f}", None, f"{f}.py", 1, 50) for f in "abcd"] + [(f"f{f}", "function", f"f{f}", f"m{f}", f"{f}.py", 2, 9) for f in "abcd"],
        "id string, type string, name string, parent_id string, file_path string, start_line int, end_line int",
    )
    rel = spark.createDataFrame([(1, "fa", "fb", "CALLS"), (2, "fb", "fc", "CALLS"), (3, "ma", "fb", "IMPORTS"), (4, "fa", "fa", "CALLS")], "id long, source_id string, target_id string, type string")
    entries = spark.createDataFrame([("ma", 10)], "id string, score int")
    return ents, rel, walk.file_nodes(ents, entries), walk.file_links(graph.file_edges(ents, rel))


def test_views(spark):
    ents, rel, nodes, links = _data(spark)
    seen, kept = walk.graph_view(nodes, links, "a.py", 1)
    assert [(r["file_path"], r["depth"]) for r in seen.collect()] == [("a.py", 0), ("b.py", 1)] and kept.count() == 1
    every, _ = walk.graph_view(nodes, links, None, orphans=False)
    assert {r["file_path"] for r in every.collect()} == {"a.py", "b.py", "c.py"}
    assert {r["id"] for r in walk.initial_visible(nodes, links, "a.py").collect()} == {"a.py", "b.py", "d.py"}
    opened = spark.createDataFrame([("b.py",)], "id string")
    assert {r["id"] for r in walk.visible(nodes, links, "a.py", opened).collect()} == {"a.py", "b.py", "c.py", "d.py"}
    assert {r["id"] for r in walk.highlight(links, "a.py", "b.py").collect()} == {"a.py", "b.py", "c.py"}
    out = {(r["source_id"], r["target_id"], r["direction"]) for r in walk.expand_file("b.py", ents, rel).collect()}
    assert out == {("fa", "fb", "in"), ("fb", "fc", "out"), ("ma", "fb", "in")}
    top = walk.repo_walk(nodes, links, ents, "a.py").collect()
    assert top[0]["id"] == "ma" and len(top) == 6


def test_parse(spark):
    rows = [
        (1, 'x {"intent": "feature", "retrieval_strategy": "repository_walk", "search_query": null, "confidence": 0.9} y'),
        (2, '{"intent": "repository_walk", "retrieval_strategy": "repository_walk", "confidence": 0.1}'), (3, "nothing"),
        (4, '{"intent": "odd", "retrieval_strategy": "odd", "search_query": "q"}'),
    ]
    raw = spark.createDataFrame(rows, "i int, t string").withColumn("q", F.lit("asked"))
    got = [(r["intent"], r["retrieval_strategy"], r["search_query"], r["confidence"]) for r in walk.parse_plan(raw, "t", "q").orderBy("i").collect()]
    assert got == [
        ("feature", "repository_walk", None, 0.9), ("repository_overview", "semantic_search", "asked", 0.1),
        ("query", "semantic_search", "asked", 0.0), ("query", "semantic_search", "q", 0.5),
    ]
    t = spark.createDataFrame([("x ===A=== mid ===B=== y",), ("x ===A=== tail",), ("none",)], "t string")
    assert [r[0] for r in t.select(walk.between(F.col("t"), "===A===", "===B===")).collect()] == [" mid ", " tail", ""]
    b = spark.createDataFrame([(1, '```[{"file_path": "a", "summary": "s"}]```')], "k int, t string")
    assert [tuple(r) for r in walk.parse_batch(b, "k", "t").collect()] == [(1, "a", "s")]


def test_targeted_search(spark):
    ents, rel, *_ = _data(spark)
    vec = {"fa": [1.0, 0.0], "fb": [0.9, 0.1], "fc": [0.0, 1.0]}
    e = ents.withColumn("embedding", F.create_map(*[x for k, v in vec.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("id")])
    visited = spark.createDataFrame([("fa",)], "id string")
    core, more, seen = walk.targeted(e, rel, [1.0, 0.0], visited, 2)
    assert [(r["id"], r["rank"]) for r in core.collect()] == [("fb", 1)] and {(r["root"], r["id"], r["role"]) for r in more.collect()} == {("fb", "fc", "callee"), ("fb", "fa", "caller")}
    assert {r["id"] for r in seen.collect()} == {"fa", "fb"}
    core, more, again = walk.targeted(e, rel, [1.0, 0.0], seen, 2)  # all found are visited
    assert (core.collect(), more.collect()) == ([], []) and {r["id"] for r in again.collect()} == {"fa", "fb"}
    fails = lambda core, *_: core.select(F.raise_error(F.lit("down")).cast("string").alias("root"), F.lit("x").alias("id"), F.lit("x").alias("role"), F.lit(1).alias("depth"), F.lit("x").alias("via"))
    core, more, _ = walk.targeted(e, rel, [1.0, 0.0], visited, 2, fails)  # the expansion fails
    assert [r["id"] for r in core.collect()] == ["fb"] and more.collect() == []
    core, more, same = walk.targeted(e, rel, None, visited)  # the search fails
    assert (core.collect(), more.collect(), same.count()) == ([], [], 1)
    rows = [("rewrite_search", "new", "m"), ("rewrite_search", "", "m"), ("insufficient", "new", "m"), ("insufficient", None, ""), ("done", "new", "m")]
    asked = spark.createDataFrame(rows, "s string, r string, m string").select(walk.targeted_query(F.col("s"), F.col("r"), F.col("m"), F.lit("goal")))
    assert [r[0] for r in asked.collect()] == ["new", "goal", "m", "goal", "goal"]


def test_traces_and_entities_of_nodes(spark):
    ents, rel, nodes, _ = _data(spark)
    found = graph.expand(spark.createDataFrame([("fa", 1)], "id string, rank int"), ents, rel)
    assert [tuple(r) for r in walk.traces(found, ents).collect()] == [("fa", "  -> fa calls fb [b.py:2]\n    -> fb calls fc [c.py:2]")]
    got = {r["file_path"]: [x["id"] for x in r["entities"]] for r in walk.with_entities(nodes, ents).collect()}
    assert got == {f"{f}.py": [f"f{f}"] for f in "abcd"}
