"""Quotas, summaries and marks as stateful processors with timers, time to live and a first state.

``transformWithStateInPandas`` keeps state in RocksDB: set
``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER`` (``use_rocksdb`` does).
Each processor removes what it no longer needs by a timer on event time, so its state
is bounded by what is recent, and takes a first state from a table.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000
# The window of requests, how long its log is kept, and the share of a limit that counts as reached.
WINDOW_US, KEEP_US, SHARE = 60_000_000, 70_000_000, 0.90


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _timed(events: DataFrame, key: str, ts: str, late: int, *more: Column) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return events.select(F.col(key).cast("string").alias("key"), at.alias("_ts"), F.unix_micros(at).alias("us"), *more).withWatermark("_ts", f"{late} seconds")


class _Quota(StatefulProcessor):
    """Per key: the log of the last minute (sorted), the count of each UTC day that is not over, and until when it is exhausted.

    Rows of a batch are taken in the order of their time; one that comes after a later
    one is counted by what its own minute holds, so the counts do not depend on how
    events fall into batches, as long as they are no later than the watermark.
    """

    def __init__(self, per_minute: int, per_day: int, keep_us: int):
        self.per_minute, self.per_day, self.keep_us = per_minute, per_day, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "us array<long>")
        self.days = handle.getMapState("days", "day long", "us array<long>")
        self.held = handle.getValueState("held", "since long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        since = initialState["exhausted_us"].dropna()
        if len(since):
            self._hold(int(since.min()))

    def _hold(self, us: int) -> None:
        self.held.update((us,))
        self.handle.registerTimer((us // DAY_US + 1) * DAY_US // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["us", "id"])
        log = list(self.log.get()[0]) if self.log.exists() else []
        days = {int(d): list(self.days.getValue((int(d),))[0]) for d in {u // DAY_US for u in got["us"]} if self.days.containsKey((int(d),))}
        since = self.held.get()[0] if self.held.exists() else None
        out = []
        for us in got["us"].tolist():  # all of the batch count, those at the same time for no one
            bisect.insort(log, us)
            bisect.insort(days.setdefault(us // DAY_US, []), us)
        bad = got.loc[got["bad"], "us"]
        for us in bad.tolist():
            if since is None or us < since and us // DAY_US == since // DAY_US or us // DAY_US > since // DAY_US:
                since = us
        for us, i in zip(got["us"].tolist(), got["id"].tolist(), strict=True):
            recent = bisect.bisect_left(log, us) - bisect.bisect_right(log, us - WINDOW_US)
            today = bisect.bisect_left(days[us // DAY_US], us)
            held = since is not None and since < us and since // DAY_US == us // DAY_US
            ok = not held and (self.per_minute <= 0 or recent < int(self.per_minute * SHARE)) and (self.per_day <= 0 or today < int(self.per_day * SHARE))
            out.append((key[0], i, recent, today, held, ok))
        newest = log[-1]
        del log[: bisect.bisect_right(log, newest - self.keep_us)]
        self.log.update((log,))
        self.handle.registerTimer((newest + self.keep_us) // 1000)
        for day, times in days.items():
            self.days.updateValue((day,), (times,))
            self.handle.registerTimer((day + 1) * DAY_US // 1000 + self.keep_us // 1000)
        if len(bad):
            self._hold(since)
        yield pd.DataFrame(out, columns=["key", "id", "recent", "today", "exhausted", "available"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.log.exists() and self.log.get()[0][-1] + self.keep_us <= now + 999:
            self.log.clear()
        for (day,) in [tuple(d) for d in self.days.keys()]:
            if (day + 1) * DAY_US + self.keep_us <= now + 999:
                self.days.removeKey((day,))
        if self.held.exists() and (self.held.get()[0] // DAY_US + 1) * DAY_US <= now:
            self.held.clear()
        yield pd.DataFrame([], columns=["key", "id", "recent", "today", "exhausted", "available"])

    def close(self) -> None:
        pass


def quota(requests: DataFrame, key: str, ts: str, id_col: str, failed: Column | None = None, per_minute: int = 0, per_day: int = 0, late: int = 120, initial: DataFrame | None = None) -> DataFrame:
    """(key, id, recent, today, exhausted, available) of every request.

    recent: earlier requests of the key in the last 60 seconds; today: earlier ones of
    the UTC day; exhausted: a request ``failed`` for quota earlier in the day; available:
    neither that nor 90 % of a limit (0: none). Events later than ``late`` seconds are dropped.
    State goes by itself: the log after 70 seconds and what ``late`` adds, counts and
    marks when their day is over. ``initial`` (key, exhausted_us) are marks that hold
    from the start.
    """
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    rows = _timed(requests, key, ts, late, F.col(id_col).cast("long").alias("id"), bad.alias("bad"))
    first = None if initial is None else initial.select(F.col("key").cast("string").alias("key"), F.col("exhausted_us").cast("long").alias("exhausted_us")).groupBy("key")
    # What is late by up to ``late`` must still find its minute.
    return rows.groupBy("key").transformWithStateInPandas(_Quota(per_minute, per_day, KEEP_US + late * 1_000_000), "key string, id long, recent long, today long, exhausted boolean, available boolean", "Append", "EventTime", first)


class _Summary(StatefulProcessor):
    """Per conversation: summary, the turn that it reaches to, and the turns that wait for the next."""

    def __init__(self, fold: Callable, least: int, idle_us: int):
        self.fold, self.least, self.idle_us = fold, least, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "summary string, through long")
        self.waiting = handle.getListState("waiting", "turn long, text string")
        self.seen = handle.getValueState("seen", "us long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("through").iloc[-1]
        self.done.update((last["summary"], int(last["through"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        summary, through = self.done.get() if self.done.exists() else ("", -1)
        waiting = dict(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else {}
        got = pd.concat(list(rows))
        for turn, text in zip(got["turn"].tolist(), got["text"].tolist(), strict=True):
            if turn > through:  # a turn that comes twice is one
                waiting.setdefault(int(turn), text)
        # Turns are folded in their order, and none before those that are still missing.
        out = []
        while True:
            run = [t for i, t in enumerate(sorted(waiting)) if t == through + 1 + i][: self.least]
            if len(run) < self.least:
                break
            summary, through = self.fold(summary, [waiting.pop(t) for t in run]), run[-1]
            out.append((key[0], summary, through))
        self.done.update((summary, through))
        if waiting:
            self.waiting.put(sorted(waiting.items()))
        else:
            self.waiting.clear()
        newest = max(int(got["us"].max()), self.seen.get()[0] if self.seen.exists() else 0)
        self.seen.update((newest,))
        self.handle.registerTimer((newest + self.idle_us) // 1000)
        yield pd.DataFrame(out, columns=["key", "summary", "through"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] + self.idle_us <= expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999:
            for state in (self.done, self.waiting, self.seen):
                state.clear()
        yield pd.DataFrame([], columns=["key", "summary", "through"])

    def close(self) -> None:
        pass


def rolling_summary(turns: DataFrame, key: str, ts: str, turn: str, text: str, fold: Callable | None = None, least: int = 4, idle: int = 3600, late: int = 120, initial: DataFrame | None = None) -> DataFrame:
    """(key, summary, through): a row whenever ``least`` turns in a row have come since the last summary.

    ``fold`` (summary, texts) -> summary is the caller's; texts are joined by default.
    Turns are counted from 0; those that come out of order wait for the ones before, and
    one that comes again is left out, so summaries do not depend on batches. A
    conversation that is ``idle`` for so many seconds loses its state; ``initial`` (key, summary, through) is
    where conversations go on from.
    """
    fold = fold or (lambda summary, texts: "\n".join([*([summary] if summary else []), *texts]))
    rows = _timed(turns, key, ts, late, F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"))
    first = None if initial is None else initial.select(F.col("key").cast("string").alias("key"), "summary", F.col("through").cast("long").alias("through")).groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(_Summary(fold, least, idle * 1_000_000), "key string, summary string, through long", "Append", "EventTime", first)
