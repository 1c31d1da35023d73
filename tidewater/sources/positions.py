"""Position and end-offset scans (S1-S3) and their join into samples.

Any DataFrame with the POSITIONS / WATERMARKS schema can be fed in: a
parquet table, a table of the catalog, a stream, or a bridge over the
driver's tables.  The reference reads both sides "now"; here both sides are
aligned to a tick first (`align_to_tick`) so J1 stays an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import epoch_us, floor_tick_us, from_epoch_us
from ..schemas import KEY, LOG_KEY


def read_positions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Committed offsets.  Rows without a topic are skipped (a group with
    no entry yields zero rows)."""
    df = spark.read.format(fmt).load(path)
    return positions_from(df)


def with_arrival(df: DataFrame) -> DataFrame:
    """Adds `seq`, the place of each row in its source files (time of the
    file, path, row), to a Parquet scan or stream: the order of arrival of
    rows with equal key and time.  Later files hold later arrivals."""
    m = "_metadata."
    return df.withColumn("seq", F.struct(F.unix_micros(m + "file_modification_time").alias("file_us"),
                                         F.col(m + "file_path").alias("file"), F.col(m + "row_index").alias("row")))


def _seq(df: DataFrame) -> list[str]:
    return ["seq"] if "seq" in df.columns else []


def positions_from(df: DataFrame) -> DataFrame:
    return df.filter(F.col("topic").isNotNull()).select(
        "cluster", "group_id", "topic", F.col("partition").cast("int"), "ts",
        F.col("committed_offset").cast("long"), *_seq(df))


def read_watermarks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Only the high end of each partition is kept (a low column, if
    present, is dropped by the projection and pruned from the scan)."""
    return watermarks_from(spark.read.format(fmt).load(path))


def watermarks_from(df: DataFrame) -> DataFrame:
    return df.select("cluster", "topic", F.col("partition").cast("int"), "ts",
                     F.col("high_watermark").cast("long"))


def list_groups(positions: DataFrame) -> DataFrame:
    """S3: the group roster per cluster."""
    return positions.select("cluster", "group_id").distinct()


def align_to_tick(df: DataFrame, keys: list[str], value: str, step_us: int,
                  tie_break: list[str] | None = None) -> DataFrame:
    """Bucket free-form samples to ticks and keep the newest value per
    (keys, tick).  Tie rule: newest ts wins, then the larger value."""
    t = epoch_us("ts", df.schema["ts"].dataType)
    order = [F.col("ts"), F.col(value)] + [F.col(c) for c in (tie_break or [])]
    return (df.withColumn("tick_us", floor_tick_us(t, step_us))
            .groupBy(*keys, "tick_us")
            .agg(F.max_by(F.col(value), F.struct(*order)).alias(value))
            .select(*keys, from_epoch_us("tick_us").alias("ts"), value))


def lag_of(hwm: str, off: str):
    """lag = max(end - committed, 0); NULL when either side is missing
    (Spark's greatest() would skip the NULL)."""
    h, o = F.col(hwm), F.col(off)
    return F.when(h.isNotNull() & o.isNotNull(), F.greatest(h - o, F.lit(0))).cast("long")


def join_watermarks(positions: DataFrame, watermarks: DataFrame) -> DataFrame:
    """J1 + P1: positions LEFT JOIN end offsets on (cluster, topic, partition, ts).

    Many groups share one end offset.  Catalyst/AQE choose the strategy: the
    watermark side is broadcast only when its measured size is under
    `spark.sql.autoBroadcastJoinThreshold`, otherwise both sides are
    shuffled on the join key.  Output = samples:
    KEY, ts, ts_us, committed_offset, high_watermark, lag (NULL when either
    side is missing; P2/P3 decide what happens to those rows).
    """
    j = positions.join(watermarks.drop("seq"), LOG_KEY + ["ts"], "left")
    return (j.withColumn("ts_us", epoch_us("ts", j.schema["ts"].dataType))
            .withColumn("lag", lag_of("high_watermark", "committed_offset"))
            .select(*KEY, "ts", "ts_us", "committed_offset", "high_watermark", "lag", *_seq(positions)))


def samples_from(df: DataFrame) -> DataFrame:
    """Samples given directly (both offsets in one row), e.g. Bridge A."""
    return (df.withColumn("ts_us", epoch_us("ts", df.schema["ts"].dataType))
            .withColumn("lag", lag_of("high_watermark", "committed_offset"))
            .select(*KEY, "ts", "ts_us", F.col("committed_offset").cast("long"),
                    F.col("high_watermark").cast("long"), F.col("lag").cast("long"), *_seq(df)))

