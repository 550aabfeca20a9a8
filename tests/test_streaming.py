"""Streams against batch forms, restarts, state that goes, sinks that write once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import memory as M
from sparkloom.sources import tables as S
from sparkloom.streaming import quota as K
from sparkloom.streaming import sink, stateful

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 5, 1, 23, 58, 0)
SCHEMA = "id long, key string, ts timestamp, bad boolean, turn long, text string"


def _stream(spark, name):
    df = S.read(spark, SF, name)
    return spark.readStream.schema(df.schema).parquet(f"{SF}/{name}.parquet*")


class Feed:
    """A folder that batches of rows are added to, and a query over it that is stopped and started again for each."""

    def __init__(self, spark, folder, make, mode="append"):
        self.spark, self.make, self.mode = spark, make, mode
        self.at, self.mark, self.out = (str(folder / n) for n in ("in", "mark", "out"))
        self.n = 0

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.at)
        df = self.make(self.spark.readStream.schema(SCHEMA).parquet(self.at))
        q = df.writeStream.outputMode(self.mode).format("parquet").option("checkpointLocation", self.mark).trigger(availableNow=True).start(self.out)
        q.awaitTermination()
        return q

    def rows(self):
        return self.spark.read.parquet(self.out).collect()

    def state(self, name):
        df = self.spark.read.format("statestore").option("path", self.mark).option("stateVarName", name).load()
        return df.count()


@pytest.fixture
def rocks(spark):
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _event(i, key, seconds, bad=False, turn=0, text=""):
    return (i, key, START + dt.timedelta(seconds=seconds), bad, turn, text)


def _quota_of(events):
    """What a loop over all events says."""
    us = lambda e: int(e[2].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    out = {}
    for e in events:
        mine = [x for x in events if x[1] == e[1] and us(x) < us(e)]
        recent = sum(us(x) > us(e) - 60_000_000 for x in mine)
        today = sum(us(x) // stateful.DAY_US == us(e) // stateful.DAY_US for x in mine)
        held = any(x[3] and us(x) // stateful.DAY_US == us(e) // stateful.DAY_US for x in mine)
        out[e[0]] = (recent, today, held, not held and recent < int(10 * 0.9) and today < int(40 * 0.9))
    return out


def test_quota_of_late_events_and_restarts_equals_a_loop(rocks, tmp_path):
    rng = random.Random(4)
    make = lambda s: stateful.quota(s, "key", "ts", "id", F.col("bad"), 10, 40)
    feed, every = Feed(rocks, tmp_path, make), []
    for b in range(4):  # a new run each, from the checkpoint; past midnight; some as late as the watermark lets them
        rows = [_event(100 * b + i, rng.choice("ab"), 60 * b + rng.randint(-40, 60), rng.random() < 0.02) for i in range(30)]
        every += rows
        feed.add(rows)
    # Counts of earlier batches cannot know of what came late; all that is late here is earlier than a minute only.
    want, got = _quota_of(every), {r["id"]: (r["recent"], r["today"], r["exhausted"], r["available"]) for r in feed.rows()}
    assert set(got) == set(want)
    last = {e[0] for e in every[90:]}
    assert {i: v for i, v in got.items() if i in last} == {i: v for i, v in want.items() if i in last}
    in_order = sorted(every, key=lambda e: e[2])
    again = Feed(rocks, tmp_path / "sorted", make)
    for b in range(0, 120, 40):
        again.add(in_order[b : b + 40])
    ties = {e[0] for e in every if sum(x[2] == e[2] for x in every) > 1}
    found = {r["id"]: (r["recent"], r["today"], r["exhausted"], r["available"]) for r in again.rows()}
    assert {i: v for i, v in found.items() if i not in ties} == {i: v for i, v in want.items() if i not in ties}


def test_quota_state_goes_and_first_state_holds(rocks, tmp_path):
    day = int(dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    first = rocks.createDataFrame([("a", day), ("z", None)], "key string, exhausted_us long")
    feed = Feed(rocks, tmp_path, lambda s: stateful.quota(s, "key", "ts", "id", None, initial=first))
    feed.add([_event(1, "a", 0), _event(2, "b", 0), _event(3, "a", 180)])
    assert {r["id"]: r["exhausted"] for r in feed.rows()} == {1: True, 2: False, 3: False}  # midnight is between
    assert feed.state("log") == 2
    feed.add([_event(4, "c", 3 * 86_400)])
    feed.add([_event(5, "c", 3 * 86_400 + 1)])  # timers go off by the watermark of the batch before
    assert (feed.state("log"), feed.state("held"), feed.state("days")) == (1, 0, 1)


def test_summaries_do_not_depend_on_batches(rocks, tmp_path):
    rng = random.Random(2)
    rows = [_event(i, key, i, turn=i, text=f"{key}{i}") for key in "xyz" for i in range(11)]
    rng.shuffle(rows)
    fold = lambda s, texts: f"({s}{'+'.join(texts)})"
    make = lambda s: stateful.rolling_summary(s, "key", "ts", "turn", "text", fold, 4)
    one, many = Feed(rocks, tmp_path / "one", make), Feed(rocks, tmp_path / "many", make)
    one.add(rows + rows[:5])
    for at in range(0, len(rows), 9):
        many.add(rows[at : at + 9] + rows[:2])
    want = {(k, f"({k}0+{k}1+{k}2+{k}3)", 3) for k in "xyz"} | {(k, f"(({k}0+{k}1+{k}2+{k}3){k}4+{k}5+{k}6+{k}7)", 7) for k in "xyz"}
    assert {tuple(r) for r in one.rows()} == want and {tuple(r) for r in many.rows()} == want and len(many.rows()) == len(want)
    assert many.state("waiting") == 3 * 3
    many.add([_event(99, "w", 7 * 3600)])
    many.add([_event(98, "w", 7 * 3600 + 1, turn=1)])
    assert (many.state("done"), many.state("seen")) == (1, 1) and many.state("waiting") == 2


def test_summary_goes_on_from_a_table(rocks, tmp_path):
    first = rocks.createDataFrame([("x", "S", 3)], "key string, summary string, through long")
    feed = Feed(rocks, tmp_path, lambda s: stateful.rolling_summary(s, "key", "ts", "turn", "text", None, 2, initial=first))
    feed.add([_event(i, "x", i, turn=i, text=str(i)) for i in range(2, 6)])
    assert [tuple(r) for r in feed.rows()] == [("x", "S\n4\n5", 5)]


# --- sinks


class Stops(Exception):
    pass


def test_a_write_that_stops_leaves_each_row_once(spark, tmp_path, monkeypatch):
    table = sink.KeepFirstTable(str(tmp_path / "t"), ["key"], ["id"])
    batch = lambda *rows: spark.createDataFrame([_event(*r) for r in rows], SCHEMA)
    assert table.read(spark) is None
    table.write(batch((1, "a", 0), (2, "a", 0), (3, "b", 0)), 0)
    with monkeypatch.context() as m:  # between the rows and the ledger
        m.setattr(table, "_enter", lambda *a: (_ for _ in ()).throw(Stops()))
        with pytest.raises(Stops):
            table.write(batch((4, "b", 0), (5, "c", 0)), 1)
    assert sorted(r["id"] for r in table.read(spark).collect()) == [1, 3]
    table.write(batch((4, "b", 0), (5, "c", 0)), 1)
    table.write(batch((4, "b", 0), (5, "c", 0)), 1)  # again, as after a restart
    table.write(batch((6, "c", 0), (7, "d", 0)), 2)
    assert sorted((r["key"], r["id"]) for r in table.read(spark).collect()) == [("a", 1), ("b", 3), ("c", 5), ("d", 7)] and table.epochs(spark) == [0, 1, 2]


def test_a_stream_into_the_table(spark, tmp_path):
    table, fails = sink.KeepFirstTable(str(tmp_path / "t"), ["key"], ["id"]), [2]

    def write(batch, epoch):
        table.write(batch, epoch)
        if fails and fails.pop():
            raise TimeoutError

    waits = []
    write = sink.with_retries(write, lambda e: isinstance(e, TimeoutError), sleep=waits.append)
    for part in ([(1, "a", 0), (2, "b", 0)], [(3, "b", 9), (4, "c", 9)]):
        spark.createDataFrame([_event(*r) for r in part], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["key"], r["id"]) for r in table.read(spark).collect()) == [("a", 1), ("b", 2), ("c", 4)] and waits == [2.0]


def test_retries():
    class Limited(Exception):
        def __init__(self, after):
            self.after = after

    waits, tries = [], []

    def write(batch, epoch):
        tries.append(epoch)
        raise Limited(7.5) if len(tries) == 2 else Limited(None) if len(tries) < 4 else ValueError("other")

    run = sink.with_retries(write, lambda e: isinstance(e, Limited), lambda e: e.after, base=2.0, sleep=waits.append)
    with pytest.raises(ValueError, match="other"):  # not transient: raised at once
        run(None, 3)
    assert waits == [2.0, 7.5, 8.0] and tries == [3] * 4
    waits.clear()
    with pytest.raises(TimeoutError):
        sink.with_retries(lambda *a: (_ for _ in ()).throw(TimeoutError()), lambda e: True, sleep=waits.append)(None, 0)
    assert waits == [2.0, 4.0, 8.0, 16.0, 32.0]


# --- windows, marks and facts


def test_sliding_log_equals_batch(spark):
    events = _stream(spark, "events")
    got = {r["event_id"]: r["recent"] for r in K.drain(K.sliding_log(events, "event_type", "ts", "event_id"), "log").collect()}
    want = {r["event_id"]: r["recent"] for r in M.sliding_count(S.read(spark, SF, "events"), "event_type", "ts").collect()}
    assert got == want and len(got) > 100


def test_daily_counts_equal_batch(spark):
    n = K.drain(K.daily_counts(_stream(spark, "events"), "event_type", "ts"), "daily", "complete")
    want = S.read(spark, SF, "events").groupBy("event_type", F.to_date("ts").alias("day")).count()
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in want.collect()}


def test_exhausted_equals_batch(spark):
    bad = F.col("event_type") == "error"
    got = K.drain(K.exhausted(_stream(spark, "events").withColumn("k", F.lit("m")), "k", "ts", "event_id", bad), "held")
    want = M.exhausted(S.read(spark, SF, "events").withColumn("k", F.lit("m")), "k", "ts", bad)
    assert {(r["event_id"], r["exhausted"]) for r in got.collect()} == {(r["event_id"], r["exhausted"]) for r in want.collect()}


def test_windows_sessions_and_progress(spark, tmp_path):
    rows = [_event(i, "k", s, text=str(s)) for i, s in enumerate([0, 1, 5, 59, 60, 61, 3000])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    counts = {r["until"]: r["n"] for r in K.drain(K.window_counts(stream(), "key", "ts"), "w", "complete").collect()}
    at = lambda s: START + dt.timedelta(seconds=s)
    assert counts[at(60)] == 4 and counts[at(120)] == 2 and counts[at(70)] == 3
    assert sorted((r["start"], r["n"]) for r in K.drain(K.sessions(stream(), "key", "ts", "30 minutes"), "s", "complete").collect()) == [(at(0), 6), (at(3000), 1)]
    assert [r["message"] for r in K.drain(K.progress(stream(), "key", "ts", "text"), "p", "complete").orderBy("at").collect()] == ["1", "5", "59", "61", "3000"]


def test_new_facts_and_versions(spark, tmp_path):
    schema = "user string, category string, fact string, ts timestamp"
    spark.createDataFrame([("u", "c", "f", START), ("u", "c", "f", START + dt.timedelta(hours=1)), ("u", "d", "f", START), ("v", "c", "f", START)], schema).coalesce(1).write.parquet(str(tmp_path / "facts"))
    got = K.drain(K.new_facts(spark.readStream.schema(schema).parquet(str(tmp_path / "facts")), ["user"], "ts"), "facts")
    assert sorted((r["user"], r["category"]) for r in got.collect()) == [("u", "c"), ("u", "d"), ("v", "c")]
    entries = "repo_id string, repo_indexed_at int"
    spark.createDataFrame([("a", 5), ("a", 3), ("b", None), ("c", 9)], entries).write.parquet(str(tmp_path / "entries"))
    repos = spark.createDataFrame([("a", 4), ("b", 1)], "repo_id string, indexed_at int")
    got = K.drain(K.against_versions(spark.readStream.schema(entries).parquet(str(tmp_path / "entries")), repos), "versions")
    assert [(r["repo_id"], r["repo_indexed_at"]) for r in got.collect()] == [("a", 5)]
