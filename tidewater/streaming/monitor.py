"""Streaming evaluation (ST1-ST7) with Structured Streaming + foreachBatch.

Each micro-batch of new samples is evaluated by the same batch operators:

1. the previous window tail (last N-1 windowed records per key, S9 form)
   is unioned with the new rows (ST2); rows not newer than their key's
   tail are routed to `late/` (ST7);
2. the union is evaluated, the new rows' status is written to
   `status/batch_id=<id>` and read back (cutting lineage);
3. the gate fold continues from the previous gate state (ST3), the payload of
   the events beside it, and writes event candidates to `events/batch_id=<id>`;
4. events whose fingerprint an earlier batch has written are dropped (ST4),
   and the fingerprints of buckets that can still get events are kept;
5. the new tail, gate and fingerprint state are written as version `v=<id>`.

Every output of batch k is written with overwrite under a path named by k
and only reads versions < k, so a replayed batch (after a failure) is
idempotent.  All folders live under the shared `spark.checkpoint.dir`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import Thresholds
from ..operators.evaluate import evaluate
from ..operators.incidents import PAYLOAD, STATE_EV, _typed, dedup, event_records, fold_gate
from ..sources.positions import samples_from, with_arrival
from ..sources.status_io import versions
from .snapshots import tail_rows

SAMPLE_SCHEMA = ("cluster string, group_id string, topic string, partition int, ts timestamp_ntz, "
                 "committed_offset bigint, high_watermark bigint")


class StreamingMonitor:
    def __init__(self, spark: SparkSession, th: Thresholds, root: str, *, publish: bool = True,
                 state_ttl_s: float | None = None, hot_key_rows: int | str | None = None):
        """`state_ttl_s` (ST5): keys whose newest sample is older than this,
        relative to the newest sample of the batch, drop out of the tail and
        gate state, so state stays bounded by the live keys.  `hot_key_rows`:
        keys with more rows in a batch are cut into time segments, in the window
        pass and in the gate fold, which goes on from the carried state.  Rows of
        one time are ordered by `seq` where the samples have it; rows of a time
        that an earlier batch has seen are late."""
        self.spark, self.th, self.root, self.publish = spark, th, root.rstrip("/"), publish
        self.state_ttl_s, self.hot_key_rows = state_ttl_s, hot_key_rows

    # -- versioned tables -------------------------------------------------
    def _versions(self, name: str) -> list[int]:
        return versions(self.spark, f"{self.root}/{name}")

    def _read_before(self, name: str, batch_id: int) -> DataFrame | None:
        vs = [v for v in self._versions(name) if v < batch_id]
        return self.spark.read.parquet(f"{self.root}/{name}/v={vs[-1]}") if vs else None

    def _write(self, df: DataFrame, name: str, batch_id: int, prefix: str = "v") -> str:
        p = f"{self.root}/{name}/{prefix}={batch_id}"
        df.write.mode("overwrite").parquet(p)
        return p

    # -- one micro-batch --------------------------------------------------
    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        th = self.th
        new = samples_from(batch).withColumn("_new", F.lit(True))
        tail = self._read_before("tail", batch_id)
        gate = self._read_before("gate", batch_id)
        if tail is not None:
            last = tail.groupBy(*S.KEY).agg(F.max("ts_us").alias("_last"))
            j = new.join(last, S.KEY, "left")
            late = j.filter(F.col("ts_us") <= F.col("_last")).drop("_last", "_new")
            self._write(late, "late", batch_id, "batch_id")
            new = j.filter(F.col("_last").isNull() | (F.col("ts_us") > F.col("_last"))).drop("_last")
            combined = new.unionByName(tail.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        else:
            combined = new
        ev = evaluate(combined, th, passthrough=("_new",), hot_key_rows=self.hot_key_rows)
        status_path = self._write(ev.filter(F.col("_new")).drop("_new"), "status", batch_id, "batch_id")
        status = self.spark.read.parquet(status_path)

        keep = combined.drop("_new").select(*S.KEY, "ts", "ts_us", "committed_offset", "high_watermark", "lag",
                                               *(["seq"] if "seq" in combined.columns else []))
        tail_new = tail_rows(keep, max(th.window_size - 1, 1))
        live = None
        if self.state_ttl_s is not None:  # ST5: drop state of keys idle longer than the TTL
            # the time, the live keys and all that is cut by them read the tail as written once
            path = self._write(tail_new, "recent", batch_id)
            tail_new = self.spark.read.schema(tail_new.schema).parquet(path)
            # a batch of late rows only has no newer sample: the newest tail row keeps the time
            horizon = tail_new.select(F.max("ts_us")).scalar() - F.lit(int(self.state_ttl_s * 1_000_000))
            live = (tail_new.groupBy(*S.KEY).agg(F.max("ts_us").alias("_last"))
                    .filter(F.col("_last") >= horizon).select(*S.KEY))
            tail_new = tail_new.join(live, S.KEY, "left_semi")

        if self.publish:
            fold = fold_gate(status, th, gate, emit_state=True, hot_key_rows=self.hot_key_rows, payload=True)
            fold_path = self._write(fold, "fold", batch_id, "batch_id")
            folded = self.spark.read.parquet(fold_path)
            det = _typed(folded, *[c for c in PAYLOAD if c in folded.columns])
            prints = self._read_before("prints", batch_id)
            fresh = dedup(event_records(status, det, th))
            if prints is not None:  # ST4: an event of an earlier batch holds its fingerprint
                fresh = fresh.join(prints, "fingerprint", "left_anti")
            path = self._write(fresh, "events", batch_id, "batch_id")
            seen = self.spark.read.parquet(path).select("fingerprint", "dedup_bucket_s")
            if prints is not None:
                seen = seen.unionByName(prints)
            if self.state_ttl_s is not None:  # buckets that closed before the horizon get no more events
                seen = seen.filter(F.col("dedup_bucket_s") * 1_000_000 >= horizon - F.lit(int(th.dedup_s * 1_000_000)))
            self._write(seen, "prints", batch_id)
            new_state = folded.filter(F.col("ev") == STATE_EV).select(*S.KEY, "prev_st", "last_us")
            if gate is not None:
                new_state = new_state.unionByName(gate.join(new_state.select(*S.KEY), S.KEY, "left_anti"))
            if live is not None:
                new_state = new_state.join(live, S.KEY, "left_semi")
            self._write(new_state, "gate", batch_id)

        self._write(tail_new, "tail", batch_id)

    # -- outputs ------------------------------------------------------------
    def status(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/status")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/events")

    def late(self) -> DataFrame:
        return self.spark.read.schema(SAMPLE_SCHEMA).parquet(f"{self.root}/late")


def run_available(spark: SparkSession, monitor: StreamingMonitor, source_glob: str,
                  checkpoint: str | None = None, max_files: int | None = None, arrival: bool = False) -> None:
    """ST1: process every file that has arrived, then stop (trigger
    availableNow); run again later to pick up new files.  A long-running
    deployment uses trigger(processingTime=check_interval) instead.  With
    `arrival`, rows of one key and time are ordered by their place in the files."""
    reader = spark.readStream.schema(SAMPLE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(source_glob)
    q = ((with_arrival(rows) if arrival else rows).writeStream
         .foreachBatch(monitor.process_batch)
         .option("checkpointLocation", checkpoint or f"{monitor.root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def dedup_stream(events: DataFrame, dedup_s: float) -> DataFrame:
    """ST4: streaming de-duplication on fingerprint within the dedup window
    (state is dropped once the watermark passes)."""
    ts = F.timestamp_seconds(F.col("ts_us") / 1_000_000) if "ts_us" in events.columns else F.col("timestamp")
    return (events.withColumn("_evt", ts).withWatermark("_evt", f"{int(dedup_s)} seconds")
            .dropDuplicatesWithinWatermark(["fingerprint"]).drop("_evt"))
