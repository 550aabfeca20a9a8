"""Numbers of a run that come with it: counts of what is written without a second pass, and the progress of streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Progress events that a listener keeps.
KEPT = 1000


class Ingest:
    """Counts of entities and edges as they are written.

    ``entities`` and ``edges`` give the frames to write; after the write, ``counts`` has
    what was written, by type, and how many rows lack what they need. One pass: the
    numbers are those of the job that writes.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def observe(self, df: DataFrame, name: str, metrics: Mapping[str, Column]) -> DataFrame:
        """``df`` as it is; ``metrics`` are aggregates, worked out while it is written for the first time."""
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], *[c.alias(n) for n, c in metrics.items()])

    def entities(self, df: DataFrame, types: tuple[str, ...]) -> DataFrame:
        per = {t: F.count_if(F.col("type") == t) for t in types}
        return self.observe(df, "entities", {"rows": F.count("*"), **per, "without_source": F.count_if(F.coalesce(F.length("source"), F.lit(0)) == 0)})

    def edges(self, df: DataFrame, types: tuple[str, ...]) -> DataFrame:
        per = {t: F.count_if(F.col("type") == t) for t in types}
        return self.observe(df, "edges", {"rows": F.count("*"), **per, "external": F.count_if(F.col("target_id").isNull())})

    def counts(self) -> dict[str, dict[str, Any]]:
        """By frame; waits for the first job of each, so each must have been written."""
        return {n: dict(o.get) for n, o in self.seen.items()}


class Progress(StreamingQueryListener):
    """Keeps the last ``KEPT`` batches of all streams: query, batch, rows in, milliseconds, late rows dropped and rows of state; and how queries ended."""

    def __init__(self) -> None:
        self.batches: deque[tuple] = deque(maxlen=KEPT)
        self.ended: deque[tuple[str, str | None]] = deque(maxlen=KEPT)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = list(p.stateOperators)
        took = int(p.durationMs.get("triggerExecution", 0)) if p.durationMs else 0
        self.batches.append((p.name, p.batchId, p.numInputRows, took, sum(s.numRowsDroppedByWatermark for s in state), sum(s.numRowsTotal for s in state)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, rows_in, ms, late, state_rows)."""
        return spark.createDataFrame(list(self.batches), "query string, batch long, rows_in long, ms long, late long, state_rows long")
