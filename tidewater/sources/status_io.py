"""Status table sink and pruned readers.

Evaluated rows are stored partitioned by (cluster, day), so a per-cluster or
per-day report reads only its folders.  Writes of one run go to their own
partitions with dynamic overwrite, so a re-run of a day replaces exactly
that day.  Reports on the latest state read a latest-per-key table that each
run merges its rows into, which keeps keys that have been silent for days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400 * 1_000_000


def with_day(df: DataFrame) -> DataFrame:
    """`day` = whole days since 1970 of ts_us (zone independent, INT)."""
    return df.withColumn("day", F.floor(F.col("ts_us") / F.lit(DAY_US)).cast("int"))


def write_status(evaluated: DataFrame, path: str) -> None:
    """Write evaluated rows partitioned by cluster and day, replacing only
    the (cluster, day) partitions present in this batch."""
    (with_day(evaluated).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("cluster", "day").parquet(path))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def update_latest(rows: DataFrame, path: str, run: int, keys: list[str]) -> DataFrame:
    """The newest row per key over all runs so far, kept as `path`/v=<run>.

    Run `run` merges its rows into the newest earlier version, so a key whose
    last sample is days old stays; a replayed run overwrites its own version.
    The newest time per key is a hash aggregate; the rows join it.  Of rows
    with equal key and time the one of the later run wins."""
    spark = rows.sparkSession
    before = [v for v in versions(spark, path) if v < run]
    now = rows.withColumn("_rank", F.col("ts_us") * 2 + 1)
    if before:
        now = now.unionByName(spark.read.parquet(f"{path}/v={before[-1]}").withColumn("_rank", F.col("ts_us") * 2))
    top = now.groupBy(*keys).agg(F.max("_rank").alias("_rank"))
    kept = now.join(top, [*keys, "_rank"], "left_semi").drop("_rank").select(*rows.columns)
    kept.write.mode("overwrite").parquet(f"{path}/v={run}")
    return spark.read.parquet(f"{path}/v={run}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a latest-per-key table."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions `v=<n>` below a folder of any file system, in order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [st.getPath() for st in fs.listStatus(folder)]
    return sorted(int(p.getName()[2:]) for p in found
                  if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
