"""Status reports (Q1-Q11, T1-T2, J4-J6, A11, A14-A15) as DataFrames.

What the reference serves over HTTP is answered here by filters and joins
on the latest status tables; nothing is computed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codes import (code_filter, health_code, health_label, status_code, status_label,
                               trend_code, trend_label)

OUTCOME_CLUSTER_UNKNOWN = "cluster_not_found"
OUTCOME_GROUP_UNKNOWN = "group_not_found"
OUTCOME_FOUND = "found"


def clusters_report(clusters: DataFrame, latest_groups: DataFrame) -> DataFrame:
    """Q1: name, enabled, broker count, number of collected groups, last
    error (never set by the collector, kept as NULL)."""
    counts = latest_groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("groups"))
    return (clusters.join(counts, clusters["name"] == counts["cluster"], "left")
            .select("name", "enabled", F.size("brokers").alias("brokers"),
                    F.coalesce("groups", F.lit(0)).cast("long").alias("groups"),
                    F.lit(None).cast("string").alias("last_error")))


def cluster_status(latest_groups: DataFrame, cluster: str) -> DataFrame:
    """Q2: all group rows of one cluster (pushed-down filter)."""
    return latest_groups.filter(F.col("cluster") == cluster)


def cluster_groups(latest_groups: DataFrame, cluster: str) -> DataFrame:
    """Q3: group ids of one cluster."""
    return latest_groups.filter(F.col("cluster") == cluster).select("cluster", "group_id")


def group_lookup(latest_groups: DataFrame, clusters: DataFrame, requests: DataFrame) -> DataFrame:
    """Q4/P5: resolve (cluster, group_id) requests to one of three outcomes.
    Group ids may contain '/'; requests carry them as separate columns."""
    known = clusters.select(F.col("name").alias("cluster"), F.lit(True).alias("_known"))
    r = (requests.join(known, "cluster", "left")
         .join(latest_groups, S.GROUP_KEY, "left"))
    outcome = (F.when(F.col("_known").isNull(), F.lit(OUTCOME_CLUSTER_UNKNOWN))
               .when(F.col("ts_us").isNull(), F.lit(OUTCOME_GROUP_UNKNOWN))
               .otherwise(F.lit(OUTCOME_FOUND)))
    return r.withColumn("outcome", outcome).drop("_known")


def group_pairs(latest_groups: DataFrame) -> DataFrame:
    """Q6: (cluster, group) list."""
    return latest_groups.select(*S.GROUP_KEY).distinct()


def readiness(clusters: DataFrame, latest_groups: DataFrame) -> DataFrame:
    """Q7: ready iff at least one cluster has at least one collected group.

    A union of configured clusters and per-cluster group counts followed by
    one aggregate - no join, so no join condition can degenerate when the
    cluster column is a constant."""
    cfg = clusters.filter(F.col("enabled")).select(F.col("name").alias("cluster"), F.lit(1).alias("cfg"),
                                                   F.lit(0).cast("long").alias("g"))
    got = latest_groups.groupBy("cluster").agg(F.lit(0).alias("cfg"), F.count(F.lit(1)).alias("g"))
    per = cfg.unionByName(got).groupBy("cluster").agg(F.max("cfg").alias("cfg"), F.sum("g").alias("g")) \
        .filter(F.col("cfg") == 1)
    agg = per.agg(F.count(F.lit(1)).alias("clusters_total"), F.count_if(F.col("g") > 0).alias("clusters_ready"))
    return agg.select(
        (F.col("clusters_ready") > 0).alias("ready"),
        F.col("clusters_total").cast("long"), F.col("clusters_ready").cast("long"),
        F.when(F.col("clusters_total") == 0, F.lit("no_clusters_configured"))
        .when(F.col("clusters_ready") == 0, F.lit("no_ready_clusters")).alias("reason"))


def overview(latest_groups: DataFrame) -> DataFrame:
    """Q9 + T2: one row per group: overall status, total lag, error and
    warning partitions; sorted by total lag (desc), then group.

    Built as the dashboard's outer join of per-group series (J4), here
    directly one aggregate row per group."""
    return (latest_groups.select(
        *S.GROUP_KEY, F.col("overall_health").alias("status"), health_code("overall_health").alias("status_code"),
        "total_lag", F.col("critical_count").alias("error_partitions"),
        F.col("warning_count").alias("warning_partitions"))
        .orderBy(F.col("total_lag").desc(), "cluster", "group_id"))


def merge_series(*series: DataFrame, order_col: str = "ts_us") -> DataFrame:
    """Outer-merge several per-group series by (cluster, group): for every
    column the last non-null value wins.  A union + one aggregate instead of
    a chain of full outer joins."""
    cols = sorted({c for s in series for c in s.columns} - set(S.GROUP_KEY) - {order_col})
    aligned = []
    for s in series:
        aligned.append(s.select(*S.GROUP_KEY, order_col,
                                *[(F.col(c) if c in s.columns else F.lit(None)).alias(c) for c in cols]))
    u = aligned[0]
    for a in aligned[1:]:
        u = u.unionByName(a, allowMissingColumns=True)
    return u.groupBy(*S.GROUP_KEY).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in cols])


def partition_series(status: DataFrame, cluster: str, group: str) -> DataFrame:
    """Q10: lag series of one group's partitions."""
    return (status.filter((F.col("cluster") == cluster) & (F.col("group_id") == group))
            .select("topic", "partition", "ts_us", F.col("current_lag").alias("lag")))


def partition_detail(latest: DataFrame, status_pattern: str = ".*") -> DataFrame:
    """Q11 + J5 + X9: latest lag, status, trend, health per partition with
    display labels; optional status-code filter such as `0` or `[1-4]`."""
    d = latest.select(*S.KEY, "current_lag", status_code("status").alias("status_code"),
                      trend_code("lag_trend").alias("trend_code"), health_code("health").alias("health_code"))
    d = d.select("*", status_label(F.col("status_code")).alias("status_label"),
                 trend_label(F.col("trend_code")).alias("trend_label"),
                 health_label(F.col("health_code")).alias("health_label"))
    return d.filter(code_filter(F.col("status_code"), status_pattern))


def top_groups_by_lag(latest_groups: DataFrame, k: int = 10) -> DataFrame:
    """T1 (dashboard form): top-k groups by total lag, tie-break by name.
    orderBy + limit plans as TakeOrderedAndProject (no full sort)."""
    return (latest_groups.select(*S.GROUP_KEY, "total_lag")
            .orderBy(F.col("total_lag").desc(), "cluster", "group_id").limit(k))


def event_summary(events: DataFrame, first_n: int = 3, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Count per event type, and the first `first_n` events of each.

    The per-type top-k is two-phase so no event type (there are five, and
    one may hold most events) is ranked in a single task: first the top
    `first_n` within (type, salt), salt = hash of the key, then the final
    ranking over at most salts x first_n candidates per type."""
    counts = events.groupBy("type").agg(F.count(F.lit(1)).alias("events"))
    order = ["ts_us", "cluster", "group_id", "topic", "partition"]
    salted = events.withColumn("_salt", F.pmod(F.xxhash64(*S.KEY), F.lit(salts)))
    w1 = Window.partitionBy("type", "_salt").orderBy(*order)
    cand = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= first_n).drop("_r", "_salt")
    w2 = Window.partitionBy("type").orderBy(*order)
    firsts = cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= first_n)
    return counts, firsts


def missing_event_types(events: DataFrame, expected: list[str] = S.EVENT_TYPES) -> DataFrame:
    """Expected event types that were not detected (left anti join)."""
    exp = events.sparkSession.createDataFrame([(t,) for t in expected], "type string")
    return exp.join(events.select("type").distinct(), "type", "left_anti")


def active_only(windows: DataFrame, active_groups: DataFrame) -> DataFrame:
    """Keep state only for groups in the active set (left semi join)."""
    return windows.join(active_groups.select(*S.GROUP_KEY).distinct(), S.GROUP_KEY, "left_semi")


def ready_groups(status: DataFrame, threshold: float = 50.0) -> DataFrame:
    """A group is ready once a window completeness >= threshold was seen
    (order-free rewrite of "first non-zero completeness")."""
    return (status.groupBy(*S.GROUP_KEY).agg(F.max("window_completeness").alias("max_completeness"))
            .withColumn("ready", F.col("max_completeness") >= threshold))
