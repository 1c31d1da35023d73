"""Counters that go on over runs (error totals, duration buckets).

Every run writes its own increments under `runs/v=<run>`, so a replayed run
replaces them and changes nothing.  `compact` sums the runs so far into
`base/v=<run>`; a reader adds the later runs to the newest base, and a run
that a base holds already is not written again.  Counters are merged by
addition, so merged runs equal one run over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .status_io import versions


class CumulativeSeries:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], counters: list[str]):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.counters = keys, counters

    def _base(self) -> int | None:
        found = versions(self.spark, f"{self.root}/base")
        return found[-1] if found else None

    def _sum(self, parts: DataFrame) -> DataFrame:
        # the sum keeps the counter's type: long for counts, double for sums
        return parts.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.counters])

    def add(self, increments: DataFrame, run: int) -> None:
        """Write the increments of `run`: rows of (keys, counters)."""
        base = self._base()
        if base is None or run > base:
            self._sum(increments).write.mode("overwrite").parquet(f"{self.root}/runs/v={run}")

    def total(self) -> DataFrame:
        """The counters over all runs; an error if nothing was ever added."""
        base = self._base()
        paths = [f"{self.root}/runs/v={v}" for v in versions(self.spark, f"{self.root}/runs") if base is None or v > base]
        if base is not None:
            paths.append(f"{self.root}/base/v={base}")
        if not paths:
            raise ValueError(f"no run has been added to {self.root}")
        return self._sum(self.spark.read.parquet(*paths).select(*self.keys, *self.counters))

    def compact(self) -> None:
        """Sum all runs so far into a new base."""
        runs = versions(self.spark, f"{self.root}/runs")
        base = self._base()
        if runs and (base is None or runs[-1] > base):
            self.total().write.mode("overwrite").parquet(f"{self.root}/base/v={runs[-1]}")
