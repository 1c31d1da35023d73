"""Group and cluster rollups.

One `groupBy(cluster, group_id, ts)` computes every per-group figure of a
collection tick in a single hash aggregate with map-side partial
aggregation: counters only, so its rows have a fixed size.  Partitions by
health are a long table; lists are built on request for one group and tick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codes import health_code, health_from_code, status_code
from ..sources.status_io import with_day
from .evaluate import KIND_UNREADABLE

PARTITION_ITEM = ["topic", "partition", "status", "health", "lag_trend", "current_lag",
                  "current_offset", "high_watermark", "consumption_rate", "lag_change_rate"]


def group_status(evaluated: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A1, A2, A4, A5 (+J2): per (cluster, group_id, tick), all counters.

    partition_count counts every position row, including partitions whose
    end offset was unreadable (P3); total_lag adds current lags (no-commit
    rows add 0); active = ACTIVE or EMPTY; LAGGING and UNKNOWN count in none
    of the three counters; overall health = worst of the partitions, GOOD
    for a group without any.  The partitions by health are counts here and
    rows in `health_partitions` (A3)."""
    st, hl = F.col("status"), F.col("health")
    readable = F.col("kind") != KIND_UNREADABLE
    def count(cond, name):
        return F.count_if(cond).cast("int").alias(name)
    g = (evaluated.groupBy(*S.GROUP_KEY, "ts", "ts_us")
         .agg(F.count(F.lit(1)).cast("int").alias("partition_count"),
              F.coalesce(F.sum("current_lag"), F.lit(0)).cast("long").alias("total_lag"),
              count(st.isin(S.ACTIVE, S.EMPTY), "active_partitions"),
              count(st == S.STOPPED, "stopped_partitions"), count(st == S.STALLED, "stalled_partitions"),
              count(st == S.LAGGING, "lagging_partitions"), count(hl == S.CRITICAL, "critical_count"),
              count(hl == S.WARNING, "warning_count"), count(hl == S.GOOD, "healthy_count"),
              F.max(F.when(readable, health_code(hl))).alias("_worst")))
    g = g.withColumn("overall_health",
                     F.coalesce(health_from_code(F.greatest(F.col("_worst"), F.lit(0))), F.lit(S.GOOD))
                     ).drop("_worst")
    if members is not None:
        g = with_members(g, members)
    return g


def health_partitions(evaluated: DataFrame) -> DataFrame:
    """A3 in long form: one row per (cluster, group, tick, health, partition)
    with the partition's figures.  No row grows with a group's partitions."""
    return (evaluated.filter(F.col("health").isin(S.CRITICAL, S.WARNING, S.GOOD))
            .select(*S.GROUP_KEY, "ts_us", *PARTITION_ITEM))


def health_lists(evaluated: DataFrame, cluster: str, group_id: str, ts_us: int) -> DataFrame:
    """A3 as the three sorted lists of one group at one tick, on request."""
    one = health_partitions(evaluated.filter(
        (F.col("cluster") == cluster) & (F.col("group_id") == group_id) & (F.col("ts_us") == ts_us)))
    item = F.struct(*PARTITION_ITEM)
    return one.groupBy(*S.GROUP_KEY, "ts_us").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("health") == h, item))).alias(name)
        for name, h in (("critical_partitions", S.CRITICAL), ("warning_partitions", S.WARNING),
                        ("healthy_partitions", S.GOOD))])


def with_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Member count per group, absent -> 0.  The member table has one
    row per (cluster, group); Catalyst broadcasts it only under the size
    threshold, otherwise sort-merge joins on the group key."""
    m = members.select(*S.GROUP_KEY, F.col("members").cast("int"))
    return (groups.join(m, S.GROUP_KEY, "left")
            .withColumn("member_count", F.coalesce("members", F.lit(0))).drop("members"))


def latest_group_status(groups: DataFrame) -> DataFrame:
    """Newest tick per (cluster, group).  The newest time per group is a
    hash aggregate of one number; the group rows join it on (group, time),
    which is unique after the rollup."""
    newest = groups.groupBy(*S.GROUP_KEY).agg(F.max("ts_us").alias("ts_us"))
    return groups.join(newest, [*S.GROUP_KEY, "ts_us"], "left_semi")


def group_count_per_cluster(groups: DataFrame, exact: bool = True) -> DataFrame:
    """Active groups per cluster (exact; approx_count_distinct at scale)."""
    agg = F.count_distinct("group_id") if exact else F.approx_count_distinct("group_id")
    return groups.groupBy("cluster").agg(agg.cast("long").alias("groups"))


def group_sketches(status: DataFrame, lg_k: int = 14) -> DataFrame:
    """A7 in mergeable form: per (cluster, day) a HyperLogLog sketch of the
    group ids, to be stored; a sketch has at most 2^lg_k registers whatever
    the number of groups.  Days of different runs may repeat: sketches unite."""
    return with_day(status).groupBy("cluster", "day").agg(
        F.hll_sketch_agg("group_id", F.lit(lg_k)).alias("sketch"))


def groups_in_days(sketches: DataFrame, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """A7 over a range of days: groups per cluster, estimated from the united
    day sketches (relative standard error about 0.83 / sqrt(2^lg_k), 0.65 % at
    lg_k = 14; small numbers are exact up to hash collisions)."""
    if first_day is not None:
        sketches = sketches.filter(F.col("day") >= first_day)
    if last_day is not None:
        sketches = sketches.filter(F.col("day") <= last_day)
    return sketches.groupBy("cluster").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("long").alias("groups"))


def error_count_per_cluster(rejects: DataFrame) -> DataFrame:
    """Failed group collections per cluster (skipped partitions do not
    count).  `rejects` has one row per (cluster, group_id, tick) failure."""
    return rejects.groupBy("cluster").agg(F.count(F.lit(1)).alias("errors"))


# Default latency buckets of the metrics client library (seconds).
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def duration_counters(durations: DataFrame, value: str = "duration_s",
                      buckets: list[float] = DEFAULT_BUCKETS) -> DataFrame:
    """A9 as counters that add up over runs: per (cluster, group_id) the
    cumulative `le_<i>` counts, the count and the sum, all as conditional sums
    of one aggregate (no explode before the shuffle)."""
    v = F.col(value)
    aggs = [F.sum(F.when(v <= b, 1).otherwise(0)).cast("long").alias(f"le_{i}") for i, b in enumerate(buckets)]
    return durations.groupBy(*S.GROUP_KEY).agg(*aggs, F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"))


def histogram_rows(counters: DataFrame, buckets: list[float] = DEFAULT_BUCKETS) -> DataFrame:
    """A9 in long form: one row per `le` bucket of each group's counters."""
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return counters.select(*S.GROUP_KEY, "count", "sum", F.inline(F.array(*pairs)))


def duration_histogram(durations: DataFrame, value: str = "duration_s",
                       buckets: list[float] = DEFAULT_BUCKETS) -> DataFrame:
    """Cumulative `le` buckets per (cluster, group_id) plus count and sum."""
    return histogram_rows(duration_counters(durations, value, buckets), buckets)


def last_cycle_duration(durations: DataFrame, value: str = "duration_s") -> DataFrame:
    """A10: the latest value per cluster."""
    return durations.groupBy("cluster").agg(F.max_by(value, "ts_us").alias(value))


def lag_by_group(latest: DataFrame) -> DataFrame:
    """Sum of current lag per group (instant, on P4's latest rows)."""
    return latest.groupBy(*S.GROUP_KEY).agg(F.sum("current_lag").cast("long").alias("total_lag"))


def lag_over_time(status: DataFrame) -> DataFrame:
    """Per group and tick, plus legend values last and max per group.

    The per-tick series is a hash aggregate; the legend values are a second
    hash aggregate joined back on the group key (no window buffering a
    group's whole series in one task)."""
    per_tick = status.groupBy(*S.GROUP_KEY, "ts_us").agg(F.sum("current_lag").cast("long").alias("lag"))
    legend = per_tick.groupBy(*S.GROUP_KEY).agg(F.max_by("lag", "ts_us").alias("last"), F.max("lag").alias("max"))
    return per_tick.join(legend, S.GROUP_KEY)


def count_by_status_code(latest: DataFrame) -> DataFrame:
    """Partitions per status code over all groups; absent codes -> 0.

    The code table is the fixed set of codes; a left join from it keeps
    codes that have no partition."""
    codes = sorted(set(S.STATUS_CODES.values()) | {-1})
    counts = latest.groupBy(status_code("status").alias("status_code")).agg(
        F.count(F.lit(1)).alias("partitions"))
    spark = latest.sparkSession
    table = spark.createDataFrame([(c,) for c in codes], "status_code int")
    return (table.join(counts, "status_code", "left")
            .select("status_code", F.coalesce("partitions", F.lit(0)).cast("long").alias("partitions")))


def label_values(latest: DataFrame, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct groups; distinct topics of the selected groups."""
    g = latest.select("group_id").distinct()
    t = latest
    if groups is not None:
        t = t.filter(F.col("group_id").isin(groups))
    return g, t.select("topic").distinct()
