"""Caches, facts, turns, access, jobs, quotas and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import seconds_to_midnight
from .ordered import running


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def cache_lookup(entries: DataFrame, repos: DataFrame, keys: list[str]) -> DataFrame:
    """The latest complete entry of each key, if it is of the repository's present version.

    An older fresh entry is not tried when the latest one is stale.
    """
    last = latest(entries.filter("complete"), keys, [F.desc("created_at"), F.desc("id")])
    return last.join(repos, "repo_id").filter("repo_indexed_at is not null and repo_indexed_at >= indexed_at")


def new_facts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Trimmed facts, category ``general`` if empty, that are neither there nor twice in the batch."""
    f = incoming.withColumn("fact", F.trim("fact")).filter("fact <> ''")
    f = f.withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("general")))
    on = [*keys, "category", "fact"]
    return f.dropDuplicates(on).join(existing.select(*on), on, "left_anti")


def next_turn(turns: DataFrame, key: str) -> DataFrame:
    return turns.groupBy(key).agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_turn"))


def unsummarised(turns: DataFrame, through: DataFrame, key: str) -> DataFrame:
    """Turns after the pointer, strictly; a pointer of 0 leaves turn 0 out, as it always was."""
    return turns.join(through, key).filter(F.col("turn") > F.col("summarized_through_turn"))


def history(turns: DataFrame, key: str) -> DataFrame:
    """``User: …`` and ``Assistant: …`` lines in order; every role but user is an assistant."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    per = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return per.select(key, F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("history"))


def title(turns: DataFrame, key: str) -> DataFrame:
    """The first user message; 57 characters and an ellipsis if it has over 60."""
    first = turns.filter("role = 'user'").groupBy(key).agg(F.min_by("text", "turn").alias("t"))
    return first.select(key, F.when(F.length("t") > 60, F.concat(F.substring("t", 1, 57), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def last_turns(turns: DataFrame, key: str, n: int) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def visible_repos(repos: DataFrame, grants: DataFrame, user) -> DataFrame:
    """All of them for nobody in particular, else those granted."""
    if user is None:
        return repos
    return repos.join(grants.filter(F.col("user_id") == F.lit(user)).select("repo_id"), "repo_id", "left_semi")


def access(requests: DataFrame, grants: DataFrame, repos: DataFrame) -> DataFrame:
    """The granted role, else viewer of a ready repository, else denied."""
    df = requests.join(grants, ["user_id", "repo_id"], "left").join(repos.select("repo_id", "status"), "repo_id", "left")
    return df.withColumn("decision", F.when(F.col("role").isNotNull(), F.col("role")).when(F.col("status") == "ready", "viewer").otherwise("denied"))


def grant(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (user_id, repo_id): the new role counts."""
    return grants.join(new, ["user_id", "repo_id"], "left_anti").unionByName(new)


def ensure(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Insert only: a role that is there is never lowered."""
    return grants.unionByName(new.join(grants, ["user_id", "repo_id"], "left_anti"))


def job_states(events: DataFrame, key: str) -> DataFrame:
    """The last event of each job."""
    return latest(events, [key], [F.desc("ts"), F.desc("event_id")])


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Earlier events of the key in the last ``seconds``; the lower bound is not part of it, nor is the row itself."""
    # Each event is seen in its own span of ``seconds`` and in the next, so a window holds
    # two spans of one key, however many events the key has.
    span = seconds * 1_000_000
    df = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    df = df.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    df = df.withColumn("_span", F.floor(F.col("_us") / span) + F.when(F.col("_own"), 0).otherwise(1))
    w = W.partitionBy(key, "_span").orderBy("_us").rangeBetween(-span + 1, -1)
    return df.withColumn("recent", F.count("*").over(w)).filter("_own").drop("_us", "_own", "_span")


def daily_count(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """``events`` with ``today``: how many of the key came earlier on the same UTC day, ties by ``tie``. A key and day of any size is many ranges."""
    return running(events.withColumn("_day", F.to_date(ts)), [key, "_day"], [ts, tie], {}).withColumnRenamed("pos", "today").drop("_day")


def exhausted(events: DataFrame, key: str, ts: str, failed: Column) -> DataFrame:
    """``events`` with ``exhausted``: whether the key has failed for its quota earlier on the same UTC day, until which ends nothing more is sent to it."""
    day = F.to_date(ts)
    first = events.filter(failed).groupBy(key, day.alias("_day")).agg(F.min(ts).alias("_failed"))
    df = events.withColumn("_day", day).join(first, [key, "_day"], "left")
    return df.withColumn("exhausted", F.coalesce(F.col(ts) > F.col("_failed"), F.lit(False))).drop("_day", "_failed")


def quota_status(events: DataFrame, models: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """Per model: requests of the last 60 seconds and of the day, and the seconds for which either is held; 0 and null without any."""
    at, t = F.unix_micros(now.cast("timestamp")), F.unix_micros(F.col(ts).cast("timestamp"))
    recent = (t > at - 60_000_000) & (t <= at)
    today = (F.to_date(ts) == F.to_date(now)) & (t <= at)
    counts = events.groupBy(key).agg(F.count_if(recent).alias("rpm_last_60s"), F.count_if(today).alias("rpd_today"), F.max(F.when(t <= at, t)).alias("_last"))
    df = models.select(key).join(counts, key, "left").na.fill(0, ["rpm_last_60s", "rpd_today"])
    kept = 70 - F.floor((at - F.col("_last")) / 1_000_000)
    return df.select(key, "rpm_last_60s", "rpd_today", F.when(kept > 0, kept).alias("rpm_ttl"), F.when(F.col("rpd_today") > 0, seconds_to_midnight(now)).alias("rpd_ttl"))


def fail_open(requests: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Requests with ``available`` out of what the store says (key, available); True where it says nothing."""
    return requests.join(state.select(key, F.col("available").alias("_ok")), key, "left").withColumn("available", F.coalesce("_ok", F.lit(True))).drop("_ok")


def retry_due(now: Column, failed_at: Column, seconds: int = 30) -> Column:
    """Whether a store that failed is asked again."""
    return failed_at.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(failed_at.cast("timestamp")) >= seconds * 1_000_000)


def available(recent: Column, today: Column, rpm: int, rpd: int, share: float = 0.9) -> Column:
    """Below the share of both limits; a limit of 0 is none."""
    ok = F.lit(True)
    if rpm:
        ok &= recent < rpm * share
    if rpd:
        ok &= today < rpd * share
    return ok


def candidates(models: DataFrame, task: str, tokens: int, skip: list[str] | None = None, provider: str | None = None, model: str | None = None, headroom: int = 512) -> DataFrame:
    """Models that fit, by tier preference and then position in the catalogue."""
    order = {"reasoning": ("reasoning", "standard", "fast"), "fast": ("fast", "standard", "reasoning")}.get(task, ("standard", "reasoning", "fast"))
    df = models.filter(F.col("max_context") >= tokens + headroom)
    df = df.filter(~F.col("provider").isin(*skip)) if skip else df
    df = df.filter(F.col("provider") == provider) if provider else df
    df = df.filter(F.col("model_id") == model) if model else df
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tier"))
    return df.withColumn("tier_rank", F.when(rank == 0, 2).otherwise(rank)).orderBy("tier_rank", "position")


def metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per scenario: precision at k, recall (over 1 if hits repeat), reciprocal rank of the first hit."""
    rel = relevant.withColumn("hit", F.lit(1))
    n = relevant.groupBy("scenario").agg(F.count("*").alias("n_rel"))
    top = results.filter(F.col("rank") <= k).join(rel, ["scenario", "id"], "left")
    per = top.groupBy("scenario").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("precision"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    first = results.join(rel, ["scenario", "id"]).groupBy("scenario").agg(F.min("rank").alias("first"))
    out = n.join(per, "scenario", "left").join(first, "scenario", "left")
    return out.select("scenario", F.coalesce("precision", F.lit(0.0)).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.col("n_rel")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def diff(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: missing, extra, different or equal."""
    e = expected.select(*keys, F.struct(*values).alias("e"))
    a = actual.select(*keys, F.struct(*values).alias("a"))
    df = e.join(a, keys, "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("e")), "equal").otherwise("different")
    return df.select(*keys, state.alias("state"))
