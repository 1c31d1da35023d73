"""Metric table (S8, M1-M12): the gauges of the monitored system as one long
table (metric, cluster, group_id, topic, partition, value).

Label sets are fixed per metric, so labels are flat nullable columns rather
than a map.  Gauges are "last written value": partition gauges come from the
newest *windowed* evaluation of a key (no-commit rows write none), the
end-offset gauge has no group label so groups overwrite each other (newest
wins), and the last-activity gauge keeps its old value while the key is
inactive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codes import health_code, status_code, trend_code
from ..functions.timefn import from_epoch_us
from .evaluate import KIND_WINDOW
from .rollup import group_status

METRIC_COLUMNS = ["metric", "cluster", "group_id", "topic", "partition", "value"]

# Our metric names (one per gauge of the reference's exporter).
PARTITION_GAUGES = [
    ("consumer_lag", "current_lag"),
    ("consumer_current_offset", "current_offset"),
    ("consumer_status", "status_code"),
    ("consumer_lag_trend", "trend_code"),
    ("consumer_health", "health_code"),
    ("consumer_consumption_rate", "consumption_rate"),
    ("consumer_lag_change_rate", "lag_change_rate"),
    ("consumer_time_since_last_activity_seconds", "time_since_last_move_s"),
]
GROUP_GAUGES = [
    ("consumer_group_health", "health_code"),
    ("consumer_group_total_lag", "total_lag"),
    ("consumer_group_active_partitions", "active_partitions"),
    ("consumer_group_stopped_partitions", "stopped_partitions"),
    ("consumer_group_stalled_partitions", "stalled_partitions"),
]


def _stack(df: DataFrame, gauges: list[tuple[str, str]], labels: list[str]) -> DataFrame:
    """Unpivot gauge columns into (metric, value) rows with `stack`-like
    inline of an array of structs (a single generator, codegen-friendly)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
                      for m, c in gauges])
    lab = [F.col(c) if c in labels else F.lit(None).cast("int" if c == "partition" else "string").alias(c)
           for c in ("cluster", "group_id", "topic", "partition")]
    return df.select(*lab, F.inline(pairs)).select(*METRIC_COLUMNS)


WINDOW_VALUES = ["current_lag", "current_offset", "high_watermark", "status", "lag_trend", "health",
                 "consumption_rate", "lag_change_rate", "time_since_last_move_s"]
ROLLUP_VALUES = ["kind", "status", "health", "current_lag"]


def key_state(evaluated: DataFrame) -> DataFrame:
    """One row per KEY, all that the gauges need: the newest windowed row (`w`,
    at `w_us`), the newest row of any kind (`r`, at `ts_us`), and the last time
    the key was active.  One aggregate over the evaluated rows with partial
    aggregation; the result has as many rows as there are keys."""
    win = F.col("kind") == KIND_WINDOW
    at = F.when(win, F.col("ts_us"))
    return evaluated.groupBy(*S.KEY).agg(
        F.max_by(F.struct(*WINDOW_VALUES), at).alias("w"), F.max(at).alias("w_us"),
        F.max_by(F.struct(*ROLLUP_VALUES), F.col("ts_us")).alias("r"), F.max("ts_us").alias("ts_us"),
        # Written only while active, so the last active evaluation persists.
        F.max(F.when(win & F.col("is_active"), F.col("ts_us"))).alias("last_active_us"))


def partition_gauges(state: DataFrame) -> DataFrame:
    """M1-M8 and M10 per KEY, as last written."""
    latest = (state.filter(F.col("w_us").isNotNull()).select(*S.KEY, "w.*", "last_active_us")
              .withColumn("status_code", status_code("status"))
              .withColumn("trend_code", trend_code("lag_trend"))
              .withColumn("health_code", health_code("health")))
    g = _stack(latest, PARTITION_GAUGES, S.KEY)
    act = latest.filter(F.col("last_active_us").isNotNull()).select(
        F.lit("consumer_last_activity_timestamp").alias("metric"), *S.KEY,
        F.floor(F.col("last_active_us") / 1_000_000).cast("double").alias("value"))
    return g.unionByName(act)


def log_end_gauges(state: DataFrame) -> DataFrame:
    """M9: end offset per (cluster, topic, partition), newest write wins
    (ties between groups at the same tick: larger value)."""
    latest = state.filter(F.col("w_us").isNotNull()).groupBy(*S.LOG_KEY).agg(
        F.max(F.struct("w_us", "w.high_watermark")).alias("v"))
    return latest.select(F.lit("consumer_log_end_offset").alias("metric"), "cluster",
                         F.lit(None).cast("string").alias("group_id"), "topic", "partition",
                         F.col("v.high_watermark").cast("double").alias("value"))


def newest_groups(state: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The group rollup (A1, A2, A4, A5) of each group's newest tick."""
    newest = state.groupBy(*S.GROUP_KEY).agg(F.max("ts_us").alias("ts_us"))
    rows = state.select(*S.KEY, "ts_us", from_epoch_us("ts_us").alias("ts"), "r.*")
    return group_status(rows.join(newest, [*S.GROUP_KEY, "ts_us"], "left_semi"), members)


def group_gauges(latest_groups: DataFrame) -> DataFrame:
    """M11 (+M12 when member_count is present) from the newest group rows."""
    g = latest_groups.withColumn("health_code", health_code("overall_health"))
    gauges = list(GROUP_GAUGES)
    if "member_count" in latest_groups.columns:
        gauges.append(("consumer_group_members", "member_count"))
    return _stack(g, gauges, ["cluster", "group_id"])


def metrics_long(evaluated: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Every gauge as one long table.  The rows per key are checkpointed
    once, so the rows are evaluated once whatever number of gauges read them."""
    state = key_state(evaluated).checkpoint()
    return (partition_gauges(state).unionByName(log_end_gauges(state))
            .unionByName(group_gauges(newest_groups(state, members))))
