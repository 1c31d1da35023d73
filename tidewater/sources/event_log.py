"""An event log that consumer groups read in batches and acknowledge.

The log is an append-only table; every event has a dense sequence number
(`seq`, from 1), given by time and id within an append.  A group's state is
one row per version: the range of the batch it has claimed and whether that
batch is acknowledged.  A claim is written before its events are handed out;
a group that stops before it acknowledges gets the same batch again, so a
handler that overwrites its output per batch handles every event once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .status_io import versions


class EventLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, events: DataFrame, run: int, order: tuple[str, ...] = ("ts_us", "id")) -> None:
        """Append `events` as run number `run`; a replayed run replaces its own rows."""
        numbered(events, [F.col(c) for c in order], f"{self.root}/_ranges/v={run}", "seq", self.newest(run)).write.mode(
            "overwrite").parquet(f"{self.root}/log/v={run}")

    def newest(self, before_run: int | None = None) -> int:
        """The largest sequence number (of the runs before `before_run`)."""
        runs = [v for v in versions(self.spark, f"{self.root}/log") if before_run is None or v < before_run]
        return (self.spark.read.parquet(f"{self.root}/log/v={runs[-1]}").agg(F.max("seq")).head()[0] or self.newest(runs[-1])) if runs else 0

    def between(self, low: int, high: int) -> DataFrame:
        """Events with low < seq <= high; the bounds reach the files' statistics."""
        return self.spark.read.parquet(f"{self.root}/log").drop("v").filter((F.col("seq") > low) & (F.col("seq") <= high))


class ConsumerGroup:
    def __init__(self, log: EventLog, name: str, batch_size: int = 10):
        self.log, self.batch_size = log, batch_size
        self.path = f"{log.root}/groups/{name}"

    def _state(self) -> tuple[int, int, int, bool]:
        """(version, low, high, acknowledged) of the newest claim."""
        found = versions(self.log.spark, self.path)
        if not found:
            return 0, 0, 0, True
        row = self.log.spark.read.parquet(f"{self.path}/v={found[-1]}").head()
        return found[-1], row.low, row.high, row.acked

    def _put(self, version: int, low: int, high: int, acked: bool) -> None:
        (self.log.spark.range(1).select(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"), F.lit(acked).alias("acked"))
         .write.mode("overwrite").parquet(f"{self.path}/v={version}"))

    def poll(self) -> tuple[int, DataFrame] | None:
        """(batch number, its events): the claimed batch if it is not
        acknowledged, else the next one; None if there is nothing new."""
        version, low, high, acked = self._state()
        if acked:
            low, high = high, min(high + self.batch_size, self.log.newest())
            if high == low:
                return None
            version += 1
            self._put(version, low, high, False)
        return (version + 1) // 2, self.log.between(low, high)

    def ack(self) -> None:
        """Acknowledge the claimed batch."""
        version, low, high, acked = self._state()
        if not acked:
            self._put(version + 1, low, high, True)

    def drain(self, handle, stop_after: int | None = None) -> int:
        """Hand every new batch to `handle(events, batch number)`; with
        `stop_after`, stop like a crash before that batch is acknowledged."""
        n = 0
        while (got := self.poll()) is not None:
            handle(got[1], got[0])
            n += 1
            if n == stop_after:
                break
            self.ack()
        return n
