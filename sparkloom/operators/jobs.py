"""Jobs through their states, conversations with their turns, and which model comes next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spans
from .memory import new_facts
from .ordered import running

# States of a job, and how many conversations are listed at most.
STATES = ("pending", "running", "done", "failed")
MOST_CONVERSATIONS = 20


def transitions(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """``events`` with ``legal``: whether the job was in a state from which that event leads on.

    A job begins pending, runs, and ends done or failed; progress comes while it runs; a
    job that could not be queued fails without having run; nothing follows an end. Where
    a job begins, runs and ends are three aggregations, each after the one before: no
    events of a job are folded.
    """
    at = F.struct(*order)
    begun = events.filter(F.col(status) == "pending").groupBy(job).agg(F.min(at).alias("_p"))
    df = events.join(begun, job, "left")
    ran = df.filter((F.col(status) == "running") & (at > F.col("_p"))).groupBy(job).agg(F.min(at).alias("_r"))
    df = df.join(ran, job, "left")
    can = F.when(F.col(status) == "done", at > F.col("_r")).when(F.col(status) == "failed", at > F.col("_p"))
    ended = df.filter(can).groupBy(job).agg(F.min(at).alias("_e"))
    df = df.join(ended, job, "left")
    open_ = F.col("_e").isNull() | (at < F.col("_e"))
    legal = F.when(F.col(status) == "pending", at == F.col("_p")).when(F.col(status) == "running", (at >= F.col("_r")) & open_).when(F.col(status).isin("done", "failed"), at == F.col("_e"))
    return df.withColumn("legal", F.coalesce(legal, F.lit(False))).select(*events.columns, "legal")


def job_states(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """(job, status, n_illegal): the state that the legal events of each job lead to, null without any, and how many were not."""
    marked = transitions(events, job, status, order)
    last = F.max_by(status, F.when(F.col("legal"), F.struct(*order)))
    return marked.groupBy(job).agg(last.alias("status"), F.count_if(~F.col("legal")).alias("n_illegal"))


def job_answers(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """What who asks (job_id, repo_id, asker) for a job (job_id, repo_id, user_id, status, result, progress, error) is told.

    ``answer`` is not_found, forbidden (the job is someone else's and both are known) or
    the status; the result is there only when it is done, progress only while it runs.
    """
    df = asked.join(jobs.withColumn("_is", F.lit(True)), ["job_id", "repo_id"], "left")
    other = F.coalesce(F.col("user_id") != F.col("asker"), F.lit(False))
    df = df.withColumn("answer", F.when(F.col("_is").isNull(), "not_found").when(other, "forbidden").otherwise(F.col("status")))
    known = ~F.col("answer").isin("not_found", "forbidden")
    shown = {"result": F.when(F.col("answer") == "done", F.col("result")), "progress": F.when(F.col("answer") == "running", F.col("progress")), "error": F.when(known, F.col("error"))}
    return df.withColumns(shown).select(*asked.columns, "answer", *shown)


def saved_turns(incoming: DataFrame, conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after ``incoming`` (conversation_id, user_id, repo_id, seq, role, content, at) is saved in the order of seq.

    A conversation that is not there is made, with the turn pointer at 0, and its turns
    count from 0; in one that is, they go on from its last, and from 1 if it has none.
    """
    last = turns.groupBy("conversation_id").agg(F.max("turn_index").alias("_m"))
    known = conversations.select(F.col("id").alias("conversation_id")).join(last, "conversation_id", "left").select("conversation_id", (F.coalesce("_m", F.lit(0)) + 1).alias("_from"))
    placed = running(incoming, ["conversation_id"], ["seq"], {}).join(known, "conversation_id", "left")
    new = placed.select("conversation_id", (F.coalesce("_from", F.lit(0)) + F.col("pos")).cast("int").alias("turn_index"), "role", "content", F.col("at").alias("created_at"))
    first = incoming.groupBy("conversation_id").agg(F.min_by(F.struct("user_id", "repo_id"), "seq").alias("w"), F.min("at").alias("a"), F.max("at").alias("b"))
    made = first.join(known, "conversation_id", "left_anti").select(F.col("conversation_id").alias("id"), "w.user_id", "w.repo_id", F.lit(0).alias("summarized_through_turn"), F.col("a").alias("created_at"), F.col("b").alias("updated_at"))
    touched = conversations.join(first.select(F.col("conversation_id").alias("id"), "b"), "id", "left").withColumn("updated_at", F.coalesce("b", "updated_at"))
    every = touched.select("id", "user_id", "repo_id", "summarized_through_turn", "created_at", "updated_at").unionByName(made)
    return every, turns.select("conversation_id", "turn_index", "role", "content", "created_at").unionByName(new)


def listed(conversations: DataFrame, turns: DataFrame, user, repo, limit: int = 5) -> DataFrame:
    """The latest conversations of a user in a repository, ``MOST_CONVERSATIONS`` at most, each with its turns in order; none for nobody."""
    if user is None:
        return conversations.limit(0).select("id", "repo_id", "created_at", "updated_at").withColumn("turns", F.array(F.struct(F.lit(0).alias("turn_index"), F.lit("").alias("role"), F.lit("").alias("content"))))
    mine = conversations.filter((F.col("user_id") == F.lit(user)) & (F.col("repo_id") == F.lit(repo)))
    mine = mine.orderBy(F.desc("updated_at"), "id").limit(min(limit, MOST_CONVERSATIONS)).select("id", "repo_id", "created_at", "updated_at")
    of = turns.join(F.broadcast(mine.select(F.col("id").alias("conversation_id"))), "conversation_id")  # as few as are listed
    per = of.groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", "content"))).alias("turns"))
    return mine.join(per, "id", "left").withColumn("turns", F.coalesce("turns", F.array()))


def last_summary(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """(conversation_id, summary) of ``asked`` (conversation_id); empty without one."""
    some = conversations.select(F.col("id").alias("conversation_id"), "summary")
    return asked.select("conversation_id").join(some, "conversation_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def facts_of_tiers(tiers: dict[str, tuple[DataFrame, list[str]]], incoming: DataFrame) -> dict[str, DataFrame]:
    """New facts for each tier out of ``incoming`` (tier, user_id, repo_id, category, fact): each tier keeps its own keys and is compared with its own rows."""
    return {name: new_facts(had, incoming.filter(F.col("tier") == name).select(*keys, "category", "fact"), keys) for name, (had, keys) in tiers.items()}


def providers(skips: dict[str, bool], every: Sequence[str]) -> tuple[list[str], str | None]:
    """(those to skip, the one that is forced): flags to a set; a single one that is left is forced."""
    skip = sorted(p for p, on in skips.items() if on)
    left = [p for p in every if p not in skip]
    return skip, left[0] if len(left) == 1 else None


def next_models(candidates: DataFrame, tried: DataFrame, task: str, order: list) -> DataFrame:
    """The next model of each task: the first candidate in ``order`` that it has not tried; tasks that have tried all are not there."""
    tasks = tried.select(task).distinct()
    # Candidates are the rows of a catalogue; a task meets as many as it has tried, and one more.
    ranked = candidates.withColumn("_r", F.row_number().over(W.orderBy(*order)))
    used = tried.filter("model_id is not null").join(F.broadcast(ranked.select("model_id", "_r")), "model_id").select(task, "_r").distinct()
    gaps = used.groupBy(task).agg(F.array_sort(F.collect_set("_r")).alias("_used"))
    first = F.coalesce(F.array_min(F.filter(F.transform(F.col("_used"), lambda x, i: F.when(x != i + 1, i + 1)), lambda x: x.isNotNull())), F.size("_used") + 1)
    at = tasks.join(gaps, task, "left").withColumn("_r", F.when(F.col("_used").isNull(), 1).otherwise(first))
    return at.join(F.broadcast(ranked.select("_r", "model_id")), "_r").select(task, "model_id")


def preferred_over(results: DataFrame, wishes: DataFrame) -> DataFrame:
    """``wishes`` (scenario, preferred, over: parts of ids) with preferred_rank, over_rank (0-based, in ``results`` (scenario, rank, id)) and ``check``: passed, failed, alone or absent."""
    w = wishes.select("scenario", "preferred", "over")
    met = results.join(w, "scenario")
    rank = lambda c: F.min(F.when(F.contains("id", F.col(c)), F.col("rank") - 1))
    per = met.groupBy("scenario", "preferred", "over").agg(rank("preferred").alias("preferred_rank"), rank("over").alias("over_rank"))
    df = w.join(per, ["scenario", "preferred", "over"], "left")
    check = F.when(F.col("preferred_rank").isNull(), "absent").when(F.col("over_rank").isNull(), "alone").when(F.col("preferred_rank") < F.col("over_rank"), "passed").otherwise("failed")
    return df.withColumn("check", check)


def accessible(conversations: DataFrame, repos: DataFrame) -> DataFrame:
    """Conversations of the repositories (repo_id) that may still be seen."""
    return conversations.join(repos.select("repo_id"), "repo_id", "left_semi")


def declaration_at(declarations: DataFrame, calls: DataFrame) -> DataFrame:
    """``calls`` (file_path, line) with the smallest declaration (file_path, id, start_line, end_line) around their line; of those of one size the later one."""
    rank = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("start_line")).alias("from"), "id")
    best = spans.least_met(calls.select("file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line")), declarations.withColumn("_m", rank), ["file_path"], "_m")
    return calls.join(best.select("file_path", F.col("start_line").alias("line"), F.col("_m.id").alias("id")), ["file_path", "line"], "left")
