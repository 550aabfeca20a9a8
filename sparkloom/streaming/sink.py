"""A table that a stream adds rows to, each key once, however often an epoch is written.

An epoch's rows go to a folder of its own, which a repeated write replaces; then the
epoch enters a ledger. Readers see the epochs of the ledger only. So a write that stops
anywhere leaves nothing that is seen, and the same epoch again gives the same table.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import keep_first


class KeepFirstTable:
    """``path``/rows by epoch, and ``path``/ledger; rows are told apart by ``keys``, and of an epoch's the first in ``order`` stays."""

    def __init__(self, path: str, keys: list[str], order: list[str]):
        self.path, self.keys, self.order = path, keys, order

    def epochs(self, spark: SparkSession) -> list[int]:
        """The epochs that are part of the table; a small file each."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The table, or what it held before an epoch; None while it is empty."""
        some = [e for e in self.epochs(spark) if before is None or e < before]
        return spark.read.parquet(*[f"{self.path}/rows/epoch={e}" for e in some]) if some else None

    def write(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``: adds the rows whose keys no earlier epoch has."""
        spark = batch.sparkSession
        if epoch in self.epochs(spark):
            return
        rows, had = keep_first(batch, self.keys, self.order), self.read(spark, epoch)
        if had is not None:
            rows = rows.join(had.select(*self.keys).withColumn("_had", F.lit(1)).distinct(), self.keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")
        self._enter(spark, epoch)

    def _enter(self, spark: SparkSession, epoch: int) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/{epoch}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True).close()


def with_retries(
    write: Callable[[DataFrame, int], None], transient: Callable[[Exception], bool], retry_after: Callable[[Exception], float | None] = lambda e: None,
    tries: int = 6, base: float = 2.0, sleep: Callable[[float], None] = time.sleep, jitter: float = 0.0,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that tries again where an error is ``transient``; any other is raised at once.

    It waits for as long as ``retry_after`` finds in the error, or else ``base`` seconds,
    twice as long each time. What ``write`` does must be idempotent, as KeepFirstTable is.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        delay = base
        for i in range(tries):
            try:
                return write(batch, epoch)
            except Exception as e:
                if i == tries - 1 or not transient(e):
                    raise
                told = retry_after(e)
                sleep(told if told is not None else delay * (1 + jitter * random.random()))
                delay *= 2

    return run
