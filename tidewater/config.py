"""Evaluation thresholds and their resolution per cluster.

Durations are DOUBLE seconds and rates are per second, so every threshold
compares numerically.  The thresholds table has one row per cluster: it is
bounded by the number of configured clusters (never by the data), which is
why it is the one table this library broadcasts explicitly.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Thresholds:
    window_size: int = 10          # records kept per key (row-count window)
    min_size: int = 5              # fewer records -> UNKNOWN
    stalled_rate: float = 0.1      # consumption rate below -> STALLED (msg/s)
    rapid_rate: float = 20.0       # lag change rate above -> LAGGING (msg/s)
    trend_threshold: float = 0.1   # relative change of lag thirds
    inactivity_s: float = 45.0     # idle longer (strict) -> STOPPED
    lag_floor: int = 1000          # lag that makes INCREASING matter
    gate_s: float = 300.0          # event suppression after an event per key
    dedup_s: float = 300.0         # fingerprint bucket / de-duplication window

    def with_(self, **kw) -> "Thresholds":
        return replace(self, **kw)


THRESHOLD_SCHEMA = T.StructType([
    T.StructField("window_size", T.IntegerType()),
    T.StructField("min_size", T.IntegerType()),
    T.StructField("stalled_rate", T.DoubleType()),
    T.StructField("rapid_rate", T.DoubleType()),
    T.StructField("trend_threshold", T.DoubleType()),
    T.StructField("inactivity_s", T.DoubleType()),
    T.StructField("lag_floor", T.LongType()),
    T.StructField("gate_s", T.DoubleType()),
    T.StructField("dedup_s", T.DoubleType()),
])

HOUR = 3600.0
DAY = 86400.0
WEEK = 7 * DAY

# Settings used by the monitored system's own unit tests and dev config.
TEST_SETTINGS = Thresholds(window_size=5, min_size=2, stalled_rate=0.1, rapid_rate=1.0,
                           trend_threshold=0.1, inactivity_s=5.0)
DEV_SETTINGS = Thresholds(window_size=10, min_size=5, stalled_rate=0.1, rapid_rate=20.0,
                          trend_threshold=0.1, inactivity_s=45.0)

# Presets for the two bridges over the driver's tables (FIXTURES.md §2).
B_LONG = Thresholds(window_size=10, min_size=5, stalled_rate=0.05 / HOUR, rapid_rate=1.0 / HOUR,
                    trend_threshold=0.1, inactivity_s=6 * HOUR, lag_floor=10,
                    gate_s=3 * HOUR, dedup_s=3 * HOUR)
B_SHORT = B_LONG.with_(inactivity_s=3 * HOUR, lag_floor=20)
A_WEEKLY = Thresholds(window_size=10, min_size=5, stalled_rate=0.02 / DAY, rapid_rate=0.15 / DAY,
                      trend_threshold=0.1, inactivity_s=5 * WEEK, lag_floor=5,
                      gate_s=21 * DAY, dedup_s=21 * DAY)


def thresholds_struct(th: Thresholds) -> Column:
    """A literal STRUCT column holding `th` (field order = THRESHOLD_SCHEMA)."""
    d = asdict(th)
    return F.struct(*[F.lit(d[f.name]).cast(f.dataType).alias(f.name)
                      for f in THRESHOLD_SCHEMA.fields])


def thresholds_frame(spark: SparkSession, per_cluster: dict[str, Thresholds]) -> DataFrame:
    """One row per cluster: cluster + the flat threshold columns."""
    rows = [(name, *[getattr(th, f.name) for f in fields(Thresholds)])
            for name, th in per_cluster.items()]
    schema = T.StructType([T.StructField("cluster", T.StringType())] + THRESHOLD_SCHEMA.fields)
    rows = [tuple(_coerce(v, f.dataType) for v, f in zip(r, schema.fields)) for r in rows]
    return spark.createDataFrame(rows, schema)


def _coerce(v, dt):
    if isinstance(dt, T.DoubleType):
        return float(v)
    if isinstance(dt, (T.IntegerType, T.LongType)):
        return int(v)
    return v


CLUSTER_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("brokers", T.ArrayType(T.StringType())),
    T.StructField("override", THRESHOLD_SCHEMA),
    T.StructField("ordinal", T.IntegerType()),
])


def resolve_thresholds(clusters: DataFrame, global_cfg: Thresholds) -> DataFrame:
    """Disabled clusters are dropped; an override replaces the whole
    threshold struct (not field by field); of two enabled clusters with the
    same name the first (lowest `ordinal`) is kept and the other rejected.

    Returns (cluster, brokers, <threshold columns>) - one row per cluster.
    """
    enabled = clusters.filter(F.col("enabled"))
    first = (enabled.groupBy("name")
             .agg(F.min_by(F.struct("brokers", "override"), F.col("ordinal")).alias("c")))
    chosen = F.coalesce(F.col("c.override"), thresholds_struct(global_cfg))
    return first.select(F.col("name").alias("cluster"), F.col("c.brokers").alias("brokers"),
                        chosen.alias("t")).select("cluster", "brokers", "t.*")


def attach_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples inner-join thresholds on cluster.

    One row per configured cluster, so it is broadcast: a shuffle by cluster
    would bring all samples of a cluster into one task.
    """
    return df.join(F.broadcast(thresholds.drop("brokers")), "cluster", "inner")
