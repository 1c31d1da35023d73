"""Positions in a total order without a sort in one task.

Rows are dealt to ranges of the order and written; the ranges' counts, one
row each, say where each range begins, so no task sees more than its range
and a retried task gives the same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[Column], path: str, name: str, start: int = 0) -> DataFrame:
    """`rows` with their position `name` (from start + 1) in `order`; the
    ranges are written to `path`, replacing what an earlier try left there."""
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begin = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(start)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(begin), "_range").select(*rows.columns, (F.col("_start") + place).alias(name))
