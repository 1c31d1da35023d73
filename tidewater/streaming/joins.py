"""J1 on streams: positions and end offsets joined as they arrive.

A left outer stream-stream join on (cluster, topic, partition, ts).  Both
sides carry a watermark on `ts`, which is part of the join key, so state is
kept for `late_s` only; a position whose end offset has not come when the
watermark passes is put out without one (an unreadable partition, P2/P3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import epoch_us
from ..schemas import KEY, LOG_KEY, POSITIONS, WATERMARKS
from ..sources.positions import lag_of, positions_from, watermarks_from


def join_streams(positions: DataFrame, watermarks: DataFrame, late_s: float) -> DataFrame:
    """Samples (KEY, ts, ts_us, committed_offset, high_watermark, lag) of two streams."""
    delay = f"{int(late_s)} seconds"
    p = positions_from(positions).withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay)
    w = watermarks_from(watermarks).select(*[F.col(c).alias(f"_{c}") for c in LOG_KEY],
                                           F.col("ts").cast("timestamp").alias("_end_at"), "high_watermark").withWatermark("_end_at", delay)
    same = F.col("_at") == F.col("_end_at")
    for c in LOG_KEY:
        same = same & (F.col(c) == F.col(f"_{c}"))
    j = p.join(w, same, "left_outer")
    return (j.withColumn("ts_us", epoch_us("ts", j.schema["ts"].dataType)).withColumn("lag", lag_of("high_watermark", "committed_offset"))
            .select(*KEY, "ts", "ts_us", "committed_offset", "high_watermark", "lag"))


def run_join(spark: SparkSession, positions_glob: str, watermarks_glob: str, out: str, late_s: float) -> None:
    """Join all files that have arrived and append the samples under `out`."""
    rows = join_streams(spark.readStream.schema(POSITIONS).parquet(positions_glob),
                        spark.readStream.schema(WATERMARKS).parquet(watermarks_glob), late_s)
    q = (rows.writeStream.format("parquet").option("path", f"{out}/samples").option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
