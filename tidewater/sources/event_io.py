"""Event sink, retention and source.

The sink writes flat envelope columns plus the full JSON payload; appends
are idempotent per micro-batch when written through `write_events` with a
batch id (the batch's folder is overwritten on replay).  Retention finds its
cutoff from counts per time bucket (no global sort, nothing gathered).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..session import checkpoint_path
from .status_io import versions

PAYLOAD_FIELDS = ["id", "source", "type", "severity", "timestamp", "cluster", "title", "description", "data",
                  "fingerprint", "consumer_group", "topic", "partition", "current_lag", "current_offset",
                  "high_watermark", "lag_delta", "offset_delta", "consumption_rate", "lag_change_rate",
                  "time_since_last_move"]


def envelope(events: DataFrame, *more: str) -> DataFrame:
    """Flat columns + `event` JSON (timestamp as RFC 3339 text in the
    payload, unix seconds in the envelope), and `more` columns of the events."""
    payload = F.struct(*[
        (F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
         if c == "timestamp" else F.col(c)) for c in PAYLOAD_FIELDS])
    return events.select(
        F.to_json(payload).alias("event"), F.col("type"), F.col("severity"), F.col("cluster"),
        F.col("group_id"), F.col("topic"), F.col("partition").cast("string").alias("partition"),
        F.floor(F.col("ts_us") / 1_000_000).cast("long").alias("timestamp"), *more)


def write_events(events: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append the envelope as parquet.  With a batch id the rows go to
    `path/batch_id=<id>` in overwrite mode, so a replayed micro-batch
    replaces its own output instead of duplicating it."""
    env = envelope(events)
    if batch_id is None:
        env.write.mode("append").parquet(path)
    else:
        env.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def retain_latest(events: DataFrame, max_len: int = 100_000, time_col: str = "timestamp",
                  tie_col: str = "event", buckets: int = 1024) -> DataFrame:
    """Keep the newest `max_len` events by (time, then a unique tie
    column); rows without a time are the oldest.

    Counts per time bucket (at most `buckets` + 2 rows) give the bucket in
    which the cutoff lies.  Newer buckets stay whole; only the cutoff bucket
    is ranked, range by range (operators/ranking.py), so neither one task nor
    the driver holds `max_len` rows.  `time_col` is a whole number; `events`
    is read three times, so pass a stored table."""
    spark = events.sparkSession
    low, high, n = events.agg(F.min(time_col), F.max(time_col), F.count("*")).head()
    if n <= max_len:
        return events
    low, high = low or 0, high or 0
    width = (high - low) // buckets + 1
    bucket = F.coalesce(F.expr(f"(`{time_col}` - {low}L) div {width}L"), F.lit(-1).cast("long"))
    newer = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = (events.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
              .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))))
    cut = counts.filter((F.col("_newer") < max_len) & (F.col("_newer") + F.col("_n") >= max_len)).collect()
    if not cut:
        return events.limit(0)
    order = [F.col(time_col).desc(), F.col(tie_col).desc()]
    edge = numbered(events.filter(bucket == cut[0]._bucket), order,
                    checkpoint_path(spark, f"retain-{uuid.uuid4().hex}"), "_rank")
    return events.filter(bucket > cut[0]._bucket).unionByName(
        edge.filter(F.col("_rank") <= max_len - cut[0]._newer).drop("_rank"))


def update_retained(events: DataFrame, path: str, run: int, max_len: int = 100_000,
                    time_col: str = "timestamp", tie_col: str = "event") -> DataFrame:
    """S6 over runs: the newest `max_len` of the last earlier version and this
    run's events, written as `path`/v=<run>.  Readers take the newest complete
    version (`status_io.read_latest`), so they switch when it is complete; a
    replayed run overwrites its own version only."""
    spark = events.sparkSession
    before = [v for v in versions(spark, path) if v < run]
    if before:
        events = spark.read.parquet(f"{path}/v={before[-1]}").unionByName(events)
    retain_latest(events, max_len, time_col, tie_col).write.mode("overwrite").parquet(f"{path}/v={run}")
    return spark.read.parquet(f"{path}/v={run}")


def read_events_stream(spark: SparkSession, path: str, batch_size: int = 10) -> DataFrame:
    """The envelope table as a stream; `maxFilesPerTrigger` bounds a
    batch, the checkpoint of the consuming query is the group's position."""
    schema = "event string, type string, severity string, cluster string, group_id string, " \
             "topic string, partition string, timestamp bigint"
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_size)
            .option("recursiveFileLookup", "true").parquet(path))

