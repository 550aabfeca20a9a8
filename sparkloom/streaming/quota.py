"""Streaming forms of quotas, facts and progress; ``stateful`` and ``sink`` have those with timers and what writes."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need instants, whatever the kind of timestamp that a source has."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(events: DataFrame, key: str, ts: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Counts per key over sliding windows, with a watermark that bounds the state."""
    w = F.window(ts, length, slide)
    return _timed(events, ts, late).groupBy(F.col(key), w).agg(F.count("*").alias("n")).select(key, F.col("window.end").alias("until"), "n")


def daily_counts(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    w = F.window(ts, "1 day")
    return _timed(events, ts, late).groupBy(F.col(key), w).agg(F.count("*").alias("n")).select(key, F.to_date("window.start").alias("day"), "n")


def new_facts(facts: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Facts that are new within the watermark; those older than it are no longer held in state."""
    return _timed(facts, ts, late).dropDuplicatesWithinWatermark([*keys, "category", "fact"])


def against_versions(entries: DataFrame, repos: DataFrame) -> DataFrame:
    """Stream of cache entries against the repositories' present versions: stale ones go."""
    return entries.join(repos, "repo_id").filter("repo_indexed_at is not null and repo_indexed_at >= indexed_at")


def progress(events: DataFrame, key: str, ts: str, message: str, every: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """The last message of each key and interval."""
    w = F.window(ts, every)
    return _timed(events, ts, late).groupBy(F.col(key), w).agg(F.max_by(message, ts).alias("message")).select(key, F.col("window.end").alias("at"), "message")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by gap; an extension, the batch engine has none."""
    w = F.session_window(ts, gap)
    return _timed(events, ts, late).groupBy(F.col(key), w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding_log(events: DataFrame, key: str, ts: str, id_col: str, seconds: int = 60, keep: int = 70, late: str = "2 minutes") -> DataFrame:
    """Exact count of earlier requests in the last ``seconds`` of each key, with the times kept as state.

    Times older than ``keep`` seconds before the newest leave the state; a key without
    events for that long loses its state altogether.
    """
    out = f"{key} string, {id_col} long, recent long"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        got = pd.concat(list(batches)).sort_values(["us", id_col])
        rows = []
        for us, i in zip(got["us"], got[id_col]):
            # Times are in order, so what is recent lies between two places.
            rows.append((k[0], i, bisect.bisect_left(times, us) - bisect.bisect_right(times, us - seconds * 1_000_000)))
            bisect.insort(times, us)
        del times[: bisect.bisect_right(times, times[-1] - keep * 1_000_000)]
        state.update((times,))
        state.setTimeoutTimestamp(max(max(times) // 1000, state.getCurrentWatermarkMs()) + keep * 1000)
        yield pd.DataFrame(rows, columns=[key, id_col, "recent"])

    slim = _timed(events, ts, late).select(F.col(key), F.col(id_col), F.col(ts), F.unix_micros(ts).alias("us"))
    return slim.groupBy(key).applyInPandasWithState(run, out, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def exhausted(events: DataFrame, key: str, ts: str, id_col: str, failed: Column, late: str = "2 minutes") -> DataFrame:
    """(key, id, exhausted): whether a failure for quota came earlier in the same UTC day. The mark is state that a timer clears when the day ends."""
    day_ms = 86_400_000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = state.get[0] if state.exists else None
        got = pd.concat(list(batches)).sort_values(["us", id_col])
        rows = []
        for us, i, bad in zip(got["us"], got[id_col], got["bad"]):
            same = since is not None and since // (day_ms * 1000) == us // (day_ms * 1000)
            rows.append((k[0], i, bool(same and since < us)))
            if bad and not same:
                since = int(us)
        if since is not None:
            state.update((since,))
            state.setTimeoutTimestamp(max((since // (day_ms * 1000) + 1) * day_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, id_col, "exhausted"])

    slim = _timed(events, ts, late).select(F.col(key), F.col(id_col), F.col(ts), F.unix_micros(ts).alias("us"), failed.alias("bad"))
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} string, {id_col} long, exhausted boolean", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a query over what its source has now and return it as a table in the driver's memory: for views and tests; ``sink`` writes tables."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
