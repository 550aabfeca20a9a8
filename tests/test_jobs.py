"""Jobs, conversations and routing on literal rows."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import jobs


def test_transitions_equal_a_machine(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdefgh"), rng.choice(jobs.STATES)) for i in range(200)] + [(900, "z", "running")]
    got = {r["i"]: r["legal"] for r in jobs.transitions(spark.createDataFrame(rows, "i int, job string, status string"), "job", "status", ["i"]).collect()}
    last = {r["job"]: (r["status"], r["n_illegal"]) for r in jobs.job_states(spark.createDataFrame(rows, "i int, job string, status string"), "job", "status", ["i"]).collect()}
    leads = {None: {"pending"}, "pending": {"running", "failed"}, "running": {"running", "done", "failed"}, "done": set(), "failed": set()}
    state, bad = {}, {}
    for i, job, s in rows:
        legal = s in leads[state.get(job)]
        assert got[i] == legal
        state[job], bad[job] = s if legal else state.get(job), bad.get(job, 0) + (not legal)
    assert last == {j: (state[j], bad[j]) for j in state}


def test_answers_by_owner_and_state(spark):
    rows = [("a", "r", "u", "done", "res", "p", None), ("b", "r", None, "running", "res", "p", None), ("c", "r", "v", "failed", "res", "p", "why")]
    j = spark.createDataFrame(rows, "job_id string, repo_id string, user_id string, status string, result string, progress string, error string")
    asked = spark.createDataFrame([("a", "r", "u"), ("a", "r", "v"), ("a", "r", None), ("b", "r", "v"), ("c", "r", "v"), ("c", "r", "u"), ("a", "s", "u")], "job_id string, repo_id string, asker string")
    got = {(r["job_id"], r["repo_id"], r["asker"]): tuple(r)[3:] for r in jobs.job_answers(asked, j).collect()}
    assert got == {
        ("a", "r", "u"): ("done", "res", None, None), ("a", "r", "v"): ("forbidden", None, None, None), ("a", "r", None): ("done", "res", None, None), ("b", "r", "v"): ("running", None, "p", None),
        ("c", "r", "v"): ("failed", None, None, "why"), ("c", "r", "u"): ("forbidden", None, None, None), ("a", "s", "u"): ("not_found", None, None, None),
    }


def test_turns_are_saved_and_listed(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    convs = spark.createDataFrame([("old", "u", "r", 4), ("bare", "u", "r", 0)], "id string, user_id string, repo_id string, summarized_through_turn int").withColumns({"created_at": at(1), "updated_at": at(1)})
    turns = spark.createDataFrame([("old", 0, "user", "x"), ("old", 1, "assistant", "y")], "conversation_id string, turn_index int, role string, content string").withColumn("created_at", at(1))
    rows = [("old", "u", "r", 1, "user", "z"), ("new", "u", "r", 2, "user", "a"), ("new", "u", "r", 3, "assistant", "b"), ("bare", "u", "r", 4, "user", "c"), ("other", "v", "r", 5, "user", "d")]
    new = spark.createDataFrame(rows, "conversation_id string, user_id string, repo_id string, seq int, role string, content string").withColumn("at", F.timestamp_seconds(F.col("seq") + 10))
    c, t = jobs.saved_turns(new, convs, turns)
    assert {(r["conversation_id"], r["turn_index"], r["content"]) for r in t.collect()} == {("old", 0, "x"), ("old", 1, "y"), ("old", 2, "z"), ("new", 0, "a"), ("new", 1, "b"), ("bare", 1, "c"), ("other", 0, "d")}
    assert {(r["id"], r["summarized_through_turn"]) for r in c.collect()} == {("old", 4), ("bare", 0), ("new", 0), ("other", 0)}
    got = jobs.listed(c, t, "u", "r", 2).orderBy(F.desc("updated_at")).collect()
    assert [(r["id"], [x["content"] for x in r["turns"]]) for r in got] == [("bare", ["c"]), ("new", ["a", "b"])]
    assert jobs.listed(c, t, None, "r").collect() == [] and jobs.listed(c, t, "u", "none").collect() == []
    summed = jobs.last_summary(spark.createDataFrame([("x", "S"), ("y", None)], "id string, summary string"), spark.createDataFrame([("x",), ("y",), ("z",)], "conversation_id string"))
    assert {tuple(r) for r in summed.collect()} == {("x", "S"), ("y", ""), ("z", "")}
    assert {r["id"] for r in jobs.accessible(c, spark.createDataFrame([("r",)], "repo_id string")).collect()} == {"old", "bare", "new", "other"} and jobs.accessible(c, spark.createDataFrame([("s",)], "repo_id string")).collect() == []


def test_facts_of_three_tiers(spark):
    had = spark.createDataFrame([("u", "r", "general", "likes tea")], "user_id string, repo_id string, category string, fact string")
    rows = [("user", "u", "r", "", " likes tea "), ("user", "u", "s", "", "likes tea"), ("user", "u", None, "x", "new"), ("preference", "u", "r", "", "likes tea"), ("preference", "u", "s", None, "likes tea"), ("repo_user", "u", "r", "", "likes tea"), ("repo_user", "u", "r", "c", " ")]
    incoming = spark.createDataFrame(rows, "tier string, user_id string, repo_id string, category string, fact string")
    tiers = {"user": (had, ["user_id"]), "preference": (had, ["user_id", "repo_id"]), "repo_user": (had.limit(0), ["user_id", "repo_id"])}
    got = {k: sorted(tuple(r) for r in df.collect()) for k, df in jobs.facts_of_tiers(tiers, incoming).items()}
    assert got == {"user": [("u", "x", "new")], "preference": [("u", "s", "general", "likes tea")], "repo_user": [("u", "r", "general", "likes tea")]}


def test_routing(spark):
    every = ["groq", "gemini", "cohere"]
    assert jobs.providers({"groq": True, "gemini": False}, every) == (["groq"], None) and jobs.providers({"groq": True, "cohere": True}, every) == (["cohere", "groq"], "gemini")
    models = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "model_id string, position int")
    tried = spark.createDataFrame([("a", "m1"), ("a", "m3"), ("b", "m2"), ("c", None), ("d", "m1"), ("d", "m2"), ("d", "m3"), ("e", "gone"), ("a", "m1")], "task string, model_id string")
    assert {tuple(r) for r in jobs.next_models(models, tried, "task", ["position"]).collect()} == {("a", "m2"), ("b", "m1"), ("c", "m1"), ("e", "m1")}
    res = spark.createDataFrame([("s", 1, "x.Foo"), ("s", 2, "x.Bar"), ("t", 1, "y.Bar")], "scenario string, rank int, id string")
    wish = spark.createDataFrame([("s", "Foo", "Bar"), ("t", "Foo", "Bar"), ("u", "Foo", "Bar")], "scenario string, preferred string, over string")
    assert {(r["scenario"], r["check"], r["preferred_rank"]) for r in jobs.preferred_over(res, wish).collect()} == {("s", "passed", 0), ("t", "absent", None), ("u", "absent", None)}
    back = spark.createDataFrame([("s", "Bar", "Foo"), ("t", "Bar", "Foo")], "scenario string, preferred string, over string")
    assert {(r["scenario"], r["check"]) for r in jobs.preferred_over(res, back).collect()} == {("s", "failed"), ("t", "alone")}


def test_the_smallest_declaration_around_a_line(spark):
    d = spark.createDataFrame([("f", "C", 1, 300), ("f", "C.m", 10, 200), ("f", "C.m.inner", 20, 25), ("f", "one", 30, 35), ("f", "two", 31, 36), ("g", "x", 1, 2)], "file_path string, id string, start_line int, end_line int")
    c = spark.createDataFrame([("f", 22), ("f", 50), ("f", 250), ("f", 33), ("f", 400), ("g", 2)], "file_path string, line int")
    assert {(r["file_path"], r["line"]): r["id"] for r in jobs.declaration_at(d, c).collect()} == {("f", 22): "C.m.inner", ("f", 50): "C.m", ("f", 250): "C", ("f", 33): "two", ("f", 400): None, ("g", 2): "x"}
