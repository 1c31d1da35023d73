"""Registered queries: one per operator row of the survey (§2).

Every query reads the driver's tables (through the bridges) over their
whole extent.  Building one may run small jobs (checkpointed
pre-aggregates, the hot-key decision).  Output columns are plain
scalars with epoch-microsecond times (`ts_us`) so results compare
engine-independently.  Message text is checked by unit tests, not here.
"""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as _W
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import A_WEEKLY, B_LONG, B_SHORT, CLUSTER_SCHEMA, resolve_thresholds, thresholds_struct
from ..functions import text as TX
from ..functions.codes import health_code
from ..functions.timefn import epoch_us as _epoch_us
from ..operators import consume as CS
from ..operators import metrics as MT
from ..operators import placement as PL
from ..operators import rollup as R
from ..operators.evaluate import evaluate, latest_per_key, partition_status
from ..operators.incidents import dedup, detect, event_records, incidents
from ..operators.publishing import publish_attempts
from ..operators.rollup import latest_group_status
from ..operators.skew import Auto, plan_hot_keys
from ..session import checkpoint_path
from ..sources import event_io as EIO
from ..sources.bridges import events_samples, read_table
from ..sources.event_log import ConsumerGroup, EventLog
from ..sources.series import CumulativeSeries
from ..sources.status_io import read_latest
from ..sources.positions import align_to_tick, join_watermarks, list_groups, read_positions, read_watermarks
from ..streaming import joins as JN
from ..streaming.keyed import KeyedMonitor, fresh_enough
from ..streaming.monitor import SAMPLE_SCHEMA, StreamingMonitor, run_available
from ..streaming.snapshots import load_windows, save_windows
from . import monitor as M
from . import reports as RP

STATUS_OUT = ["cluster", "group_id", "topic", "partition", "ts_us", "kind", "current_offset",
              "high_watermark", "current_lag", "n_records", "window_completeness", "consumption_rate",
              "lag_change_rate", "is_active", "time_since_last_move_s", "lag_trend", "status", "health",
              "prev_lag"]

GROUP_OUT = ["cluster", "group_id", "ts_us", "partition_count", "total_lag", "active_partitions",
             "stopped_partitions", "stalled_partitions", "lagging_partitions", "critical_count",
             "warning_count", "healthy_count", "overall_health", "member_count"]

#: the "auto" skew policy with a floor that small data passes too
LOW_FLOOR = Auto(floor_rows=50)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _group_out(g: DataFrame) -> DataFrame:
    return g.select(*GROUP_OUT)


def worst_groups(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Flagship: which groups are in the worst state now and how much backlog
    do they carry?  Bridges A and B, latest tick per group, top-k by health
    then total lag (tie-break by cluster, group)."""
    ga = M.group_status(M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False))
    gb = M.groups_b(spark, sf_dir, B_LONG)
    ga = ga.withColumn("member_count", F.lit(0))
    latest = latest_group_status(ga.unionByName(gb))
    return (_group_out(latest)
            .withColumn("health_code", health_code("overall_health"))
            .orderBy(F.col("health_code").desc(), F.col("total_lag").desc(), "cluster", "group_id")
            .limit(k))


register("t1_worst_groups")(worst_groups)


@register("w_status_events")
def w_status_events(spark, sf_dir):
    """W1-W10 + P1-P3 over Bridge B (long-timeout preset)."""
    return M.evaluated_b(spark, sf_dir, B_LONG, messages=False).select(*STATUS_OUT)


@register("w_status_orders")
def w_status_orders(spark, sf_dir):
    """W1-W10 over Bridge A (weekly ticks, offsets may pass the end offset)."""
    return M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False).select(*STATUS_OUT)


@register("a1_group_status_events")
def a1_group_status_events(spark, sf_dir):
    """A1-A5 + J2 per (cluster, group, tick) over Bridge B."""
    return _group_out(M.groups_b(spark, sf_dir, B_LONG))


@register("a3_health_partitions")
def a3_health_partitions(spark, sf_dir):
    """A3: the partitions of every group and tick by health, long form."""
    return R.health_partitions(M.evaluated_b(spark, sf_dir, B_LONG, messages=False))


@register("a1_group_status_orders")
def a1_group_status_orders(spark, sf_dir):
    g = M.group_status(M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False))
    return _group_out(g.withColumn("member_count", F.lit(0)))


# ---------------------------------------------------------------------------
# Incident events
# ---------------------------------------------------------------------------

DETECT_OUT = ["cluster", "group_id", "topic", "partition", "ts_us", "event_type", "severity"]
EVENT_OUT = ["id", "source", "type", "severity", "ts_us", "cluster", "title", "fingerprint",
             "consumer_group", "topic", "partition", "current_lag", "current_offset", "high_watermark",
             "lag_delta", "offset_delta", "consumption_rate", "lag_change_rate", "dedup_bucket_s"]


@register("e2_incidents_events_long")
def e2_incidents_events_long(spark, sf_dir):
    """E1-E5 with the suppression gate, Bridge B, long inactivity timeout."""
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_LONG, messages=False)
    return detect(ev, B_LONG, hot).select(*DETECT_OUT)


@register("e2_incidents_events_short")
def e2_incidents_events_short(spark, sf_dir):
    """Same with the short timeout: reaches consumer_stopped from ACTIVE."""
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_SHORT, messages=False)
    return detect(ev, B_SHORT, hot).select(*DETECT_OUT)


@register("e2_incidents_orders")
def e2_incidents_orders(spark, sf_dir):
    ev, hot = M.evaluated_a_hot(spark, sf_dir, A_WEEKLY, messages=False)
    return detect(ev, A_WEEKLY, hot).select(*DETECT_OUT)


@register("e8_disabled_publisher")
def e8_disabled_publisher(spark, sf_dir):
    """A disabled publisher makes no events."""
    return incidents(M.evaluated_b(spark, sf_dir, B_SHORT), B_SHORT, enabled=False).select(*EVENT_OUT)


@register("e7_events_dedup")
def e7_events_dedup(spark, sf_dir):
    """E6 records + X5 fingerprint + E7 de-duplication (Bridge B, short timeout)."""
    return _records_b_short(spark, sf_dir).select(*EVENT_OUT)


# ---------------------------------------------------------------------------
# Scans, latest rows, rollups, reports, metrics
# ---------------------------------------------------------------------------


def _latest_b(spark, sf_dir):
    return latest_per_key(partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False)))


def _glatest_b(spark, sf_dir):
    return latest_group_status(M.groups_b(spark, sf_dir, B_LONG))


def clusters_config(spark, sf_dir) -> DataFrame:
    """Cluster configuration over the clusters present in the data: 'orders'
    overrides the global thresholds with the weekly preset, a second
    'orders' entry is a rejected duplicate, and 'archive' is disabled."""
    # a bridge has samples wherever its source table has a row
    names = (read_table(spark, sf_dir, "events").select(F.lit("events").alias("cluster")).distinct()
             .unionByName(read_table(spark, sf_dir, "lineitem").select(F.lit("orders").alias("cluster")).distinct()))
    ov = F.when(F.col("name") == "orders", thresholds_struct(A_WEEKLY))
    first = names.select(F.col("cluster").alias("name"), F.lit(True).alias("enabled"),
                         F.array(F.concat(F.col("cluster"), F.lit("-broker-1:9092")),
                                 F.concat(F.col("cluster"), F.lit("-broker-2:9092"))).alias("brokers"),
                         F.col("cluster"))
    first = first.select("name", "enabled", "brokers", ov.alias("override"),
                         F.when(F.col("name") == "orders", 1).otherwise(0).alias("ordinal"))
    extra = spark.createDataFrame(
        [("orders", True, ["dup-broker:9092"], None, 5), ("archive", False, ["old:9092"], None, 6)],
        CLUSTER_SCHEMA)
    return first.unionByName(extra)


@register("s1_positions")
def s1_positions(spark, sf_dir):
    """Committed offsets per (cluster, group, topic, partition, tick)."""
    pos, _ = events_samples(spark, sf_dir)
    from ..functions.timefn import epoch_us
    return pos.select("cluster", "group_id", "topic", "partition", epoch_us("ts").alias("ts_us"),
                      "committed_offset")


@register("s2_watermarks")
def s2_watermarks(spark, sf_dir):
    """End offsets per (cluster, topic, partition, tick)."""
    _, wm = events_samples(spark, sf_dir)
    from ..functions.timefn import epoch_us
    return wm.select("cluster", "topic", "partition", epoch_us("ts").alias("ts_us"), "high_watermark")


@register("s1_scan_aligned")
def s1_scan_aligned(spark, sf_dir):
    """S1/S2/J1 from files: positions and end offsets written off the tick
    grid, with an older reading in each tick and rows without a topic, read
    back, aligned to ticks, joined and evaluated."""
    root = checkpoint_path(spark, f"scan-{_uuid.uuid4().hex}")
    pos, wm = events_samples(spark, sf_dir)
    def spread(df, value):
        late = df.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 11 + partition % 40)"))
        early = df.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 3)")).withColumn(value, F.lit(0).cast("long"))
        return late.unionByName(early)
    spread(pos, "committed_offset").unionByName(
        pos.filter("partition = 0").withColumn("topic", F.lit(None).cast("string"))).write.parquet(f"{root}/positions")
    spread(wm, "high_watermark").withColumn("low_watermark", F.lit(0)).write.parquet(f"{root}/watermarks")
    hour = 3600 * 1_000_000
    p = align_to_tick(read_positions(spark, f"{root}/positions"), S.KEY, "committed_offset", hour)
    w = align_to_tick(read_watermarks(spark, f"{root}/watermarks"), S.LOG_KEY, "high_watermark", hour)
    return evaluate(join_watermarks(p, w), B_LONG, messages=False).select(*STATUS_OUT)


@register("s3_group_roster")
def s3_group_roster(spark, sf_dir):
    pos, _ = events_samples(spark, sf_dir)
    return list_groups(pos).unionByName(list_groups(M.samples_a(spark, sf_dir))).distinct()


@register("s4_thresholds_per_cluster")
def s4_thresholds_per_cluster(spark, sf_dir):
    """S4 + J3: resolve per-cluster thresholds (override replaces the whole
    struct, duplicates rejected, disabled dropped) and evaluate both bridges
    in one plan with their own thresholds; status counts per cluster."""
    th = M.written(resolve_thresholds(clusters_config(spark, sf_dir), B_LONG), "thresholds")
    samples = M.samples_b(spark, sf_dir).unionByName(M.samples_a(spark, sf_dir))
    ev = evaluate(samples, th, messages=False)
    return (ev.groupBy("cluster", "kind", "status").agg(F.count(F.lit(1)).alias("rows"))
            .join(F.broadcast(th.select("cluster", "window_size", "inactivity_s")), "cluster"))


@register("p4_latest_per_key")
def p4_latest_per_key(spark, sf_dir):
    return _latest_b(spark, sf_dir).select(*STATUS_OUT)


@register("a6_latest_group_status")
def a6_latest_group_status(spark, sf_dir):
    return _group_out(_glatest_b(spark, sf_dir))


@register("a7_groups_per_cluster")
def a7_groups_per_cluster(spark, sf_dir):
    g = _glatest_b(spark, sf_dir).unionByName(
        latest_group_status(M.group_status(M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False)))
        .withColumn("member_count", F.lit(0)))
    return R.group_count_per_cluster(g)


@register("a9_idle_histogram")
def a9_idle_histogram(spark, sf_dir):
    """A9 operator over idle durations of evaluated rows (hour buckets)."""
    ev = partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False))
    return R.duration_histogram(ev, "time_since_last_move_s", [3600.0 * h for h in (1, 2, 3, 6, 12, 24)])


@register("a9_cumulative_histogram")
def a9_cumulative_histogram(spark, sf_dir):
    """A9 kept across runs: idle hours in the default buckets, added week by
    week; one run is replayed before and one after a compaction."""
    ev = M.written(partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False)).select(
        *S.GROUP_KEY, "ts_us", (F.col("time_since_last_move_s") / 3600).alias("duration_s")), "durations")
    series = CumulativeSeries(spark, checkpoint_path(spark, f"durations-{_uuid.uuid4().hex}"), S.GROUP_KEY,
                              [*(f"le_{i}" for i in range(len(R.DEFAULT_BUCKETS))), "count", "sum"])
    for run in _in_runs(series, ev, R.duration_counters):
        if run == 1:
            series.compact()
    return R.histogram_rows(series.total())


def _in_runs(series, rows, counters, runs: int = 4):
    """Add the rows in `runs` equal spans of time, every run twice; yields each run's number."""
    lo, hi = rows.agg(F.min("ts_us"), F.max("ts_us")).head()
    for run in range(runs if lo is not None else 0):
        part = counters(rows.filter(F.expr(f"(ts_us - {lo}L) * {runs} div {hi - lo + 1}L") == run))
        series.add(part, run)
        yield run
        series.add(part, run)


@register("a8_cumulative_errors")
def a8_cumulative_errors(spark, sf_dir):
    """A8 kept across runs: rejected payloads per cluster, every run replayed."""
    bad = M.written(CS.quarantine(CS.parse(damaged_envelopes(spark, sf_dir))).select(
        "cluster", (F.col("timestamp") * 1_000_000).alias("ts_us")), "rejects")
    series = CumulativeSeries(spark, checkpoint_path(spark, f"errors-{_uuid.uuid4().hex}"), ["cluster"], ["errors"])
    for run in _in_runs(series, bad, R.error_count_per_cluster):
        if run == 2:
            series.compact()
    return series.total()


@register("a7_groups_by_sketch")
def a7_groups_by_sketch(spark, sf_dir):
    """A7 from stored day sketches of both bridges, united over all days."""
    seen = M.samples_b(spark, sf_dir).unionByName(M.samples_a(spark, sf_dir))
    sketches = M.written(R.group_sketches(seen), "sketches")
    return R.groups_in_days(sketches)


@register("a8_error_counts")
def a8_error_counts(spark, sf_dir):
    """A8 over the rejected payloads of the event stream, by cluster."""
    return R.error_count_per_cluster(CS.quarantine(CS.parse(damaged_envelopes(spark, sf_dir))))


@register("a10_last_duration")
def a10_last_duration(spark, sf_dir):
    """A10 over the longest idle time per cluster and tick."""
    ev = partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False))
    return R.last_cycle_duration(ev.groupBy("cluster", "ts_us").agg(F.max("time_since_last_move_s").alias("duration_s")))


@register("a12_lag_by_group")
def a12_lag_by_group(spark, sf_dir):
    return R.lag_by_group(_latest_b(spark, sf_dir))


@register("a13_lag_over_time")
def a13_lag_over_time(spark, sf_dir):
    return R.lag_over_time(partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False)))


@register("a14_status_code_counts")
def a14_status_code_counts(spark, sf_dir):
    return R.count_by_status_code(_latest_b(spark, sf_dir))


@register("a15_label_values")
def a15_label_values(spark, sf_dir):
    g, t = R.label_values(_latest_b(spark, sf_dir), ["click", "view"])
    return g.select(F.lit("group_id").alias("label"), F.col("group_id").alias("value")).unionByName(
        t.select(F.lit("topic").alias("label"), F.col("topic").alias("value")))


@register("q1_clusters")
def q1_clusters(spark, sf_dir):
    g = _glatest_b(spark, sf_dir).select("cluster", "group_id").unionByName(
        latest_group_status(M.group_status(M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False)))
        .select("cluster", "group_id"))
    cfg = clusters_config(spark, sf_dir)
    return RP.clusters_report(cfg, g)


@register("q4_group_lookup")
def q4_group_lookup(spark, sf_dir):
    """Q4/P5: every known group plus an unknown group and an unknown cluster."""
    gl = _glatest_b(spark, sf_dir)
    req = gl.select("cluster", "group_id").unionByName(
        spark.createDataFrame([("events", "no/such-group"), ("nowhere", "click")], "cluster string, group_id string"))
    cfg = clusters_config(spark, sf_dir).filter("enabled")
    r = RP.group_lookup(gl, cfg, req)
    return r.select("cluster", "group_id", "outcome", "total_lag", "overall_health")


@register("q7_readiness")
def q7_readiness(spark, sf_dir):
    return RP.readiness(clusters_config(spark, sf_dir), _glatest_b(spark, sf_dir))


@register("q9_overview")
def q9_overview(spark, sf_dir):
    return RP.overview(_glatest_b(spark, sf_dir))


@register("q10_partition_series")
def q10_partition_series(spark, sf_dir):
    st = partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False))
    return RP.partition_series(st, "events", "purchase")


@register("q11_partition_detail")
def q11_partition_detail(spark, sf_dir):
    return RP.partition_detail(_latest_b(spark, sf_dir), "[1-4]")


@register("t1_top_groups_by_lag")
def t1_top_groups_by_lag(spark, sf_dir):
    return RP.top_groups_by_lag(_glatest_b(spark, sf_dir).unionByName(
        latest_group_status(M.group_status(M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False)))
        .withColumn("member_count", F.lit(0))), 10)


@register("p7_ready_groups")
def p7_ready_groups(spark, sf_dir):
    return RP.ready_groups(partition_status(M.evaluated_b(spark, sf_dir, B_LONG, messages=False)), 80.0)


@register("j4_merge_series")
def j4_merge_series(spark, sf_dir):
    g = M.groups_b(spark, sf_dir, B_LONG)
    lag = g.select("cluster", "group_id", "ts_us", "total_lag")
    crit = g.filter(F.col("critical_count") > 0).select(
        "cluster", "group_id", "ts_us", F.col("critical_count").alias("error_partitions"))
    return RP.merge_series(lag, crit)


@register("s8_metrics_long")
def s8_metrics_long(spark, sf_dir):
    # one bridge build and one evaluation feed the partition gauges, the
    # member counts and the group rollup
    pos, wm = events_samples(spark, sf_dir)
    ev = evaluate(join_watermarks(pos, wm), B_LONG, messages=False, hot_key_rows=M.SKEW)
    return MT.metrics_long(ev, M.members_from_positions(pos))


@register("x8_key_text")
def x8_key_text(spark, sf_dir):
    g = list_groups(events_samples(spark, sf_dir)[0])
    k = g.select(TX.key_text(F.col("cluster"), F.concat(F.col("group_id"), F.lit("/v1"))).alias("key"))
    c, grp = TX.split_key_text(F.col("key"))
    return k.select("key", c.alias("cluster"), grp.alias("group_id"))


@register("a11_event_counts")
def a11_event_counts(spark, sf_dir):
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_SHORT, messages=False)
    d = detect(ev, B_SHORT, hot).withColumnRenamed("event_type", "type")
    return RP.event_summary(d)[0]


@register("a11_first_events")
def a11_first_events(spark, sf_dir):
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_SHORT, messages=False)
    d = detect(ev, B_SHORT, hot).withColumnRenamed("event_type", "type")
    return RP.event_summary(d)[1].select("type", "rank", "cluster", "group_id", "topic", "partition", "ts_us")


@register("j6_missing_event_types")
def j6_missing_event_types(spark, sf_dir):
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_LONG, messages=False)
    d = detect(ev, B_LONG, hot).withColumnRenamed("event_type", "type")
    return RP.missing_event_types(d)


@register("x10_log_lines")
def x10_log_lines(spark, sf_dir):
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_SHORT, messages=False)
    d = detect(ev, B_SHORT, hot).join(ev.select(*S.KEY, "ts_us", "current_lag", "kind").filter("kind = 'window'"),
                                  S.KEY + ["ts_us"])
    return d.select(*S.KEY, "ts_us", TX.log_line(F.col("event_type"), F.col("severity"),
                                                 F.col("current_lag")).alias("line"))


# ---------------------------------------------------------------------------
# Placement and membership (K1-K5, L1-L2) over data-derived keys/members
# ---------------------------------------------------------------------------

HB_TTL_S, HB_OFFLINE_TTL_S, HB_TIMEOUT_S = 30 * 86400.0, 7 * 86400.0, 14 * 86400.0


def placement_keys(spark, sf_dir):
    """Keys to place: one per user of the events table (grows with the data)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key")).distinct()


def placement_members(spark, sf_dir):
    """Members: one instance per nation."""
    return read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("inst-"), F.lower("n_name")).alias("member"))


def heartbeat_log(spark, sf_dir):
    """Heartbeat log: every order is a heartbeat of its customer's nation's
    instance at the order date; pending orders mark the instance offline."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.concat(F.lit("inst-"), F.lower("n_name")).alias("id"),
                    _epoch_us("o_orderdate").alias("ts_us"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("offline")).otherwise(F.lit("active")).alias("status"),
                    F.col("o_orderkey").alias("assigned_count"))


def _now_us(log):
    return log.select(F.max("ts_us")).scalar()


@register("k1_key_buckets")
def k1_key_buckets(spark, sf_dir):
    k = placement_keys(spark, sf_dir)
    return k.select("key", PL.key_bucket(F.col("key"), PL.DEFAULT_PARTITION_COUNT).alias("bucket"))


@register("k2_bucket_owners")
def k2_bucket_owners(spark, sf_dir):
    return PL.bucket_owners(placement_members(spark, sf_dir))


@register("k3_assignments")
def k3_assignments(spark, sf_dir):
    m = placement_members(spark, sf_dir)
    return PL.assignment_lists(PL.assign(placement_keys(spark, sf_dir), m), m)


@register("k4_load_report")
def k4_load_report(spark, sf_dir):
    m = placement_members(spark, sf_dir)
    return PL.load_report(PL.assign(placement_keys(spark, sf_dir), m), m)


@register("k5_churn")
def k5_churn(spark, sf_dir):
    """Keys that move when one member leaves: only that member's keys."""
    m = placement_members(spark, sf_dir)
    k = placement_keys(spark, sf_dir)
    return PL.churn(PL.assign(k, m), PL.assign(k, m.filter(F.col("member") != "inst-algeria")))


@register("l2_current_members")
def l2_current_members(spark, sf_dir):
    log = heartbeat_log(spark, sf_dir)
    return PL.current_members(log, _now_us(log), ttl_s=HB_TTL_S, offline_ttl_s=HB_OFFLINE_TTL_S)


@register("l1_active_members")
def l1_active_members(spark, sf_dir):
    log = heartbeat_log(spark, sf_dir)
    cur = PL.current_members(log, _now_us(log), ttl_s=HB_TTL_S, offline_ttl_s=HB_OFFLINE_TTL_S)
    return PL.active_members(cur, _now_us(log), HB_TIMEOUT_S).select("id", "last_heartbeat_us", "status")


@register("l3_read_assignments")
def l3_read_assignments(spark, sf_dir):
    """L3: an assignment snapshot as JSON, one entry in ten damaged, read back."""
    a = PL.assign(placement_keys(spark, sf_dir), placement_members(spark, sf_dir))
    text = F.to_json(F.array("key"))
    snap = a.select(F.col("owner").alias("member"), F.lit(1_000_000).cast("long").alias("saved_at_us"),
                    F.when(F.col("bucket") % 10 == 0, F.substring(text, 1, 3)).otherwise(text).alias("keys_json"))
    return PL.read_assignments(snap, 2_000_000)


@register("l3_stale_assignments")
def l3_stale_assignments(spark, sf_dir):
    """L3: a snapshot older than the timeout is refused as a whole."""
    a = PL.assign(placement_keys(spark, sf_dir), placement_members(spark, sf_dir))
    snap = a.select(F.col("owner").alias("member"), F.lit(1_000_000).cast("long").alias("saved_at_us"),
                    F.to_json(F.array("key")).alias("keys_json"))
    return PL.read_assignments(snap, 700_000_000)


# ---------------------------------------------------------------------------
# Event sink / retention / consumption
# ---------------------------------------------------------------------------


def _records_b_short(spark, sf_dir):
    ev, hot = M.evaluated_b_hot(spark, sf_dir, B_SHORT, messages=False)  # messages are made for events only
    return dedup(M.events_of(ev, hot, B_SHORT))


def damaged_envelopes(spark, sf_dir):
    """Envelopes of the Bridge B events where, deterministically by
    fingerprint, some payloads are missing or cut in half (C2 inputs)."""
    rec = _records_b_short(spark, sf_dir)
    env = EIO.envelope(rec, "fingerprint")
    fp0 = F.col("fingerprint").substr(1, 1)
    return env.withColumn("event", F.when(fp0 == "1", F.lit(None))
                          .when(fp0 == "0", F.expr("substring(event, 1, length(event) div 2)"))
                          .otherwise(F.col("event"))).drop("fingerprint")


@register("s5_event_envelope")
def s5_event_envelope(spark, sf_dir):
    """S5 envelope columns (the JSON text itself is checked by unit tests)."""
    env = EIO.envelope(_records_b_short(spark, sf_dir))
    return env.select("type", "severity", "cluster", "group_id", "topic", "partition", "timestamp",
                      F.get_json_object("event", "$.fingerprint").alias("fingerprint"),
                      F.get_json_object("event", "$.current_lag").cast("long").alias("current_lag"))


@register("s6_retain_latest")
def s6_retain_latest(spark, sf_dir):
    rec = M.written(_records_b_short(spark, sf_dir), "events")
    return EIO.retain_latest(rec, 100, "ts_us", "id").select("id", "ts_us", "type", "group_id", "partition")


@register("s6_retained_versions")
def s6_retained_versions(spark, sf_dir):
    """S6 over three runs of arriving events, the second replayed: the newest
    1000, ranked without a top-k."""
    rec = M.written(_records_b_short(spark, sf_dir).select("id", "ts_us", "type", "group_id", "partition"), "events")
    path = checkpoint_path(spark, f"retained-{_uuid.uuid4().hex}")
    for run in (0, 1, 1, 2):
        EIO.update_retained(rec.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == run), path, run, 1000, "ts_us", "id")
    return read_latest(spark, path)


@register("c1_parse_accepted")
def c1_parse_accepted(spark, sf_dir):
    ok = CS.accepted(CS.parse(damaged_envelopes(spark, sf_dir)))
    return ok.select("id", "type", "severity", "cluster", "consumer_group", "topic", "partition",
                     "current_lag", "fingerprint")


@register("c2_quarantine")
def c2_quarantine(spark, sf_dir):
    q = CS.quarantine(CS.parse(damaged_envelopes(spark, sf_dir)))
    return q.select("group_id", "topic", "partition", "timestamp", "reject_reason")


@register("c2_stream_quarantine")
def c2_stream_quarantine(spark, sf_dir):
    """C2/C3 in a stream: the rejects read back from the quarantine sink."""
    root = checkpoint_path(spark, f"consume-{_uuid.uuid4().hex}")
    damaged_envelopes(spark, sf_dir).write.parquet(f"{root}/events/batch_id=0")
    run = CS.fan_out([lambda good, batch_id: good.write.mode("overwrite").parquet(f"{root}/ok/batch_id={batch_id}")],
                     f"{root}/rejects")
    q = (EIO.read_events_stream(spark, f"{root}/events").writeStream
         .foreachBatch(lambda df, batch_id: run(df, batch_id))
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/rejects").select("group_id", "topic", "partition", "timestamp", "reject_reason")


# ---------------------------------------------------------------------------
# Streaming (ST1-ST3, ST7): the same samples cut into slices and fed to the
# streaming monitor must give the batch result.
# ---------------------------------------------------------------------------


STREAM_SLICES = 3


def stream_bridge_b(spark, sf_dir, th=B_SHORT, *, resend: bool = False,
                    state_ttl_s: float | None = None, hot_key_rows: int | None = None) -> StreamingMonitor:
    """Write Bridge B samples as STREAM_SLICES time slices, running the
    stream (availableNow) after each arrival; returns the monitor.  With
    `resend`, the first slice arrives again before the last one."""
    root = checkpoint_path(spark, f"stream-{_uuid.uuid4().hex}")
    samples = M.written(M.samples_b(spark, sf_dir).select(
        "cluster", "group_id", "topic", "partition", "ts", "ts_us", "committed_offset", "high_watermark"), "samples")
    bounds = samples.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    mon = StreamingMonitor(spark, th, f"{root}/out", state_ttl_s=state_ttl_s, hot_key_rows=hot_key_rows)
    span = (hi - lo + F.lit(1))
    part = F.floor((F.col("ts_us") - lo) * STREAM_SLICES / span)
    staged = samples.withColumn("_slice", part)
    order = list(range(STREAM_SLICES))
    if resend:
        order.insert(-1, 0)
    for n, i in enumerate(order):
        (staged.filter(F.col("_slice") == i).drop("_slice", "ts_us")
         .write.mode("overwrite").parquet(f"{root}/in/arrival={n}"))
        run_available(spark, mon, f"{root}/in/*/")
    return mon


@register("st2_stream_equals_batch")
def st2_stream_equals_batch(spark, sf_dir):
    """ST1/ST2: status rows from the micro-batched stream (tail carried
    between batches) - equal to the batch evaluation."""
    return stream_bridge_b(spark, sf_dir).status().select(*STATUS_OUT)


@register("st3_stream_events")
def st3_stream_events(spark, sf_dir):
    """ST3: events from the stream with the gate state carried between
    batches - equal to the batch detection."""
    ev = stream_bridge_b(spark, sf_dir).events()
    return ev.select("cluster", F.col("consumer_group").alias("group_id"), "topic", "partition", "ts_us",
                     F.col("type").alias("event_type"), "severity")


@register("st3_stream_hot_split")
def st3_stream_hot_split(spark, sf_dir):
    """ST3 with keys above 60 rows of a micro-batch cut into time segments,
    whose fold goes on from the carried gate state - equal to the batch."""
    ev = stream_bridge_b(spark, sf_dir, hot_key_rows=60).events()
    return ev.withColumnRenamed("type", "event_type").select(*DETECT_OUT)


# ---------------------------------------------------------------------------
# Rows of one key and time (W1, ST7): four ticks fall together, and `seq`, or
# the place in the files, keeps the order in which they arrived.
# ---------------------------------------------------------------------------
SAME_US = 4 * 3_600_000_000


def _same_times(spark, sf_dir):
    s = M.samples_b(spark, sf_dir).withColumn("seq", F.col("ts_us"))
    s = s.withColumn("ts_us", F.col("seq") - F.col("seq") % SAME_US)
    return s.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))


@register("w1_same_times")
def w1_same_times(spark, sf_dir):
    """Windows over rows of equal times, in their order of arrival."""
    return evaluate(_same_times(spark, sf_dir), B_LONG, messages=False).select(*STATUS_OUT, "tie")


@register("w1_same_times_hot_split")
def w1_same_times_hot_split(spark, sf_dir):
    """The same with every key above 100 samples cut into time segments."""
    return evaluate(_same_times(spark, sf_dir), B_LONG, messages=False, hot_key_rows=100).select(*STATUS_OUT, "tie")


@register("e2_same_times")
def e2_same_times(spark, sf_dir):
    """E1-E5 over rows of equal times, cut into segments; each event names
    its row by `tie` and so gets that row's offset."""
    # the gate and the join read the evaluated rows as written once
    ev = M.written(evaluate(_same_times(spark, sf_dir), B_LONG, messages=False, hot_key_rows=100), "status")
    row = ev.filter(F.col("kind") == "window").select(*S.KEY, "ts_us", "tie", "current_offset")
    return detect(ev, B_LONG, hot_key_rows=100).join(row, [*S.KEY, "ts_us", "tie"]).select(*DETECT_OUT, "tie", "current_offset")


@register("st7_same_times_stream")
def st7_same_times_stream(spark, sf_dir):
    """Two micro-batches of files that hold rows of equal times; their order
    is that of the files.  Equal to the SQL over the order of arrival."""
    root = checkpoint_path(spark, f"stream-{_uuid.uuid4().hex}")
    rows = M.written(_same_times(spark, sf_dir), "samples")
    lo, hi = rows.select(F.min("ts_us")).scalar(), rows.select(F.max("ts_us")).scalar()
    rows = rows.withColumn("_half", (F.col("ts_us") > (lo + hi) / 2).cast("int")).withColumn(
        "_place", (F.col("seq") % SAME_US / 3_600_000_000).cast("int"))
    mon = StreamingMonitor(spark, B_SHORT, f"{root}/out")
    for half in range(2):
        for place in range(4):
            (rows.filter((F.col("_half") == half) & (F.col("_place") == place))
             .select(*S.KEY, "ts", "committed_offset", "high_watermark")
             .write.mode("overwrite").parquet(f"{root}/in/arrival={half * 4 + place}"))
        run_available(spark, mon, f"{root}/in/*/", arrival=True)
    return mon.events().withColumnRenamed("type", "event_type").select(*DETECT_OUT)


#: a week of de-duplication: buckets hold several events of one key
DEDUP_WEEK = B_SHORT.with_(dedup_s=7 * 86400.0)
STREAM_TTL_S = 3650 * 86400.0


@register("e7_events_dedup_week")
def e7_events_dedup_week(spark, sf_dir):
    """E7 with a window longer than the gate, so that events are removed."""
    ev, hot = M.evaluated_b_hot(spark, sf_dir, DEDUP_WEEK, messages=False)
    return dedup(M.events_of(ev, hot, DEDUP_WEEK)).select(*EVENT_OUT)


@register("e7_orders_dedup")
def e7_orders_dedup(spark, sf_dir):
    """E6 + E7 over Bridge A; its 21-day window does not divide the year-one offset."""
    ev, hot = M.evaluated_a_hot(spark, sf_dir, A_WEEKLY, messages=False)
    return dedup(M.events_of(ev, hot, A_WEEKLY)).select(*EVENT_OUT)


@register("st4_stream_dedup")
def st4_stream_dedup(spark, sf_dir):
    """ST4: events of one dedup bucket in different batches - equal to the batch de-duplication."""
    return stream_bridge_b(spark, sf_dir, DEDUP_WEEK).events().select(*EVENT_OUT)


@register("st5_state_after_late_batch")
def st5_state_after_late_batch(spark, sf_dir):
    """ST5: with a TTL set and a batch of late rows in the middle, the status equals the batch evaluation."""
    mon = stream_bridge_b(spark, sf_dir, resend=True, state_ttl_s=STREAM_TTL_S)
    return mon.status().select(*STATUS_OUT)


@register("st7_late_rows")
def st7_late_rows(spark, sf_dir):
    """ST7: the rows that arrived again, routed aside."""
    late = stream_bridge_b(spark, sf_dir, resend=True, state_ttl_s=STREAM_TTL_S).late()
    return late.select(*S.KEY, _epoch_us("ts").alias("ts_us"), "committed_offset", "high_watermark")


# ---------------------------------------------------------------------------
# Keyed streaming state: windows and gate per key, time to live, restart
# ---------------------------------------------------------------------------

KEYED_TTL_S = 2 * 3600.0


def _arrivals(samples):
    """STREAM_SLICES equal time slices of the samples, as functions that write one."""
    lo, hi = samples.agg(F.min("ts_us").alias("lo")).scalar(), samples.agg(F.max("ts_us").alias("hi")).scalar()
    staged = samples.select(*S.KEY, "ts", "committed_offset", "high_watermark",
                            F.floor((F.col("ts_us") - lo) * STREAM_SLICES / (hi - lo + F.lit(1))).alias("_slice"))
    return [lambda path, i=i: staged.filter(F.col("_slice") == i).drop("_slice").write.parquet(f"{path}/arrival={i}")
            for i in range(STREAM_SLICES)]


def _arrive(mon: KeyedMonitor, writers, folder: str) -> None:
    for write in writers:
        write(folder)
        mon.run_windows(mon.spark.readStream.schema(SAMPLE_SCHEMA).parquet(f"{folder}/*/"))
        mon.run_gate()


def keyed_stream(spark, sf_dir, samples, ttl_s: float | None = None) -> KeyedMonitor:
    """The keyed monitor after all slices of the samples, one by one."""
    root = checkpoint_path(spark, f"keyed-{_uuid.uuid4().hex}")
    mon = KeyedMonitor(spark, B_SHORT, f"{root}/out", ttl_s=ttl_s)
    _arrive(mon, _arrivals(samples), f"{root}/in")
    return mon


def readable_samples_b(spark, sf_dir):
    """Bridge B samples whose end offset could be read: keys fall silent in between."""
    return _gappy_samples(spark, sf_dir).filter(F.col("high_watermark").isNotNull()).checkpoint()


def _event_rows(events):
    return events.select("cluster", F.col("consumer_group").alias("group_id"), "topic", "partition", "ts_us",
                         F.col("type").alias("event_type"), "severity")


@register("st2_keyed_windows")
def st2_keyed_windows(spark, sf_dir):
    """ST2: status rows with each key's window as keyed state - equal to the batch evaluation."""
    return keyed_stream(spark, sf_dir, M.samples_b(spark, sf_dir).checkpoint()).status().select(*STATUS_OUT)


@register("st3_keyed_gate")
def st3_keyed_gate(spark, sf_dir):
    """ST3: events with previous status and last event as keyed state - equal to the batch detection."""
    return _event_rows(keyed_stream(spark, sf_dir, M.samples_b(spark, sf_dir).checkpoint()).events())


@register("st5_keyed_ttl_status")
def st5_keyed_ttl_status(spark, sf_dir):
    """ST5: keys that report only when their end offset can be read, forgotten after two silent hours."""
    return keyed_stream(spark, sf_dir, readable_samples_b(spark, sf_dir), KEYED_TTL_S).status().select(*STATUS_OUT)


@register("st5_keyed_ttl_events")
def st5_keyed_ttl_events(spark, sf_dir):
    """ST5: the gate's state ends with the same silence."""
    return _event_rows(keyed_stream(spark, sf_dir, readable_samples_b(spark, sf_dir), KEYED_TTL_S).events())


@register("s10_restart")
def s10_restart(spark, sf_dir):
    """A monitor stopped before the last slice, and another one started
    from its saved windows and gates (none older than the time to live): the
    events of both equal those of an uninterrupted run."""
    root = checkpoint_path(spark, f"restart-{_uuid.uuid4().hex}")
    samples = M.samples_b(spark, sf_dir).checkpoint()
    writers = _arrivals(samples)
    first = KeyedMonitor(spark, B_SHORT, f"{root}/first")
    _arrive(first, writers[:-1], f"{root}/in")
    windows = first.saved_windows()
    as_of = windows.agg(F.max("seen_us").alias("t")).scalar()
    windows = fresh_enough(windows, as_of, 86400.0).checkpoint()
    gates = fresh_enough(first.saved_gates(), as_of, 86400.0).checkpoint()
    second = KeyedMonitor(spark, B_SHORT, f"{root}/second", windows=windows, gates=gates)
    _arrive(second, writers[-1:], f"{root}/in2")
    return _event_rows(first.events().unionByName(second.events()))


# ---------------------------------------------------------------------------
# Live inputs joined, failing publishers, consumer groups
# ---------------------------------------------------------------------------

@register("j1_stream_joined_status")
def j1_stream_joined_status(spark, sf_dir):
    """J1 as a stream-stream join: positions and end offsets arrive in files of
    their own, some end offsets never; a last row of a time after all others
    lets the watermark pass."""
    root = checkpoint_path(spark, f"joined-{_uuid.uuid4().hex}")
    pos, wm = events_samples(spark, sf_dir)
    wm = _read_ends(wm)
    hi = pos.select(F.max("ts")).scalar()
    for i in range(2):
        later = hi + F.expr(f"INTERVAL {i + 30} DAYS")
        closing = spark.range(1).select(F.lit("").alias("cluster"), F.lit("").alias("group_id"), F.lit("").alias("topic"),
                                        F.lit(0).alias("partition"), later.alias("ts"), F.lit(0).cast("long").alias("committed_offset"))
        p, w = (pos, wm) if i == 0 else (pos.limit(0), wm.limit(0))
        if i == 0:
            p.write.parquet(f"{root}/positions/n=0")
            w.write.parquet(f"{root}/watermarks/n=0")
            JN.run_join(spark, f"{root}/positions/*/", f"{root}/watermarks/*/", f"{root}/out", 86_400)
        closing.write.parquet(f"{root}/positions/n={i + 1}")
        closing.drop("group_id").withColumnRenamed("committed_offset", "high_watermark").write.parquet(f"{root}/watermarks/n={i + 1}")
        JN.run_join(spark, f"{root}/positions/*/", f"{root}/watermarks/*/", f"{root}/out", 86_400)
    samples = spark.read.parquet(f"{root}/out/samples").filter("cluster <> ''")
    return partition_status(evaluate(samples, B_LONG, messages=False)).select(*STATUS_OUT)


@register("e8_publish_outcomes")
def e8_publish_outcomes(spark, sf_dir):
    """Every attempt to publish with its outcome, when publishing fails at
    offsets divisible by 3 and the de-duplication lookup at those by 4."""
    th = DEDUP_WEEK
    ev = M.evaluated_b(spark, sf_dir, th, messages=False)
    got = publish_attempts(ev, th, publish_failed=F.col("current_offset") % 3 == 0, lookup_failed=F.col("current_offset") % 4 == 0)
    return got.drop("tie")


@register("s7_consumer_groups")
def s7_consumer_groups(spark, sf_dir):
    """Two groups over one event log in batches; one stops in the middle
    of its second batch and is started again.  Each event once per group."""
    root = checkpoint_path(spark, f"groups-{_uuid.uuid4().hex}")
    log = EventLog(spark, root)
    rec = _records_b_short(spark, sf_dir).select("id", "ts_us", "type", "group_id", "topic", "partition").checkpoint()
    middle = rec.agg(((F.min("ts_us") + F.max("ts_us")) / 2).alias("m")).scalar()
    log.append(rec.filter(F.col("ts_us") < middle), 0)

    def handler(name):
        return lambda events, batch: events.withColumn("consumer", F.lit(name)).write.mode("overwrite").parquet(
            f"{root}/handled/consumer={name}/batch={batch}")
    size = -(-log.newest() // 4)
    ConsumerGroup(log, "audit", size).drain(handler("audit"))
    ConsumerGroup(log, "alerts", size).drain(handler("alerts"), stop_after=2)
    log.append(rec.filter(F.col("ts_us") >= middle), 1)
    for name in ("audit", "alerts"):
        ConsumerGroup(log, name, size).drain(handler(name))
    return spark.read.parquet(f"{root}/handled").select("consumer", "seq", "id", "ts_us", "type", "group_id", "topic", "partition")


# ---------------------------------------------------------------------------
# Window snapshots (S9, S10) and stale-key cleanup
# ---------------------------------------------------------------------------


def _snapshot_b(spark, sf_dir):
    s = M.samples_b(spark, sf_dir)
    saved_at = s.select(F.max("ts_us")).scalar()
    return save_windows(s, B_LONG.window_size, saved_at)


@register("s9_save_windows")
def s9_save_windows(spark, sf_dir):
    snap = _snapshot_b(spark, sf_dir)
    return snap.select(*S.KEY, F.size("records").alias("records"),
                       F.col("records")[0]["ts_us"].alias("first_ts_us"),
                       F.element_at("records", -1)["committed_offset"].alias("last_offset"), "saved_at_us")


@register("s10_load_windows")
def s10_load_windows(spark, sf_dir):
    """Round trip: saved windows reloaded as records (within the TTL)."""
    snap = _snapshot_b(spark, sf_dir)
    as_of = snap.select(F.max("saved_at_us")).scalar()
    return load_windows(snap, as_of, 86400.0)


@register("p6_active_windows")
def p6_active_windows(spark, sf_dir):
    """Keep window snapshots only for groups still in the active set
    (groups whose latest group row has an active partition)."""
    snap = _snapshot_b(spark, sf_dir)
    active = _glatest_b(spark, sf_dir).filter(F.col("active_partitions") > 0)
    return RP.active_only(snap, active).select(*S.KEY, "saved_at_us")


@register("w_status_events_hot_split")
def w_status_events_hot_split(spark, sf_dir):
    """W1-W10 with hot-key splitting forced on (every key above 100 samples
    is cut into time segments with halos); must equal the plain pass."""
    return evaluate(M.samples_b(spark, sf_dir), B_LONG, messages=False, hot_key_rows=100).select(*STATUS_OUT)


@register("e2_incidents_hot_split")
def e2_incidents_hot_split(spark, sf_dir):
    """E1-E5 with both the window pass and the gate fold split for hot keys
    (forced at 100 rows per segment); must equal the sequential fold."""
    ev = evaluate(M.samples_b(spark, sf_dir), B_LONG, messages=False, hot_key_rows=100)
    return detect(ev, B_LONG, hot_key_rows=100).select(*DETECT_OUT)


@register("w_status_auto_split")
def w_status_auto_split(spark, sf_dir):
    """The "auto" policy with a floor low enough that it splits keys here."""
    s = M.samples_b(spark, sf_dir)
    return evaluate(s, B_LONG, messages=False, hot_key_rows=plan_hot_keys(s, LOW_FLOOR)).select(*STATUS_OUT)


@register("e2_incidents_auto_split")
def e2_incidents_auto_split(spark, sf_dir):
    s = M.samples_b(spark, sf_dir)
    hot = plan_hot_keys(s, LOW_FLOOR)
    return detect(evaluate(s, B_LONG, messages=False, hot_key_rows=hot), B_LONG, hot).select(*DETECT_OUT)


def _per_cluster(spark, sf_dir):
    th = M.written(resolve_thresholds(clusters_config(spark, sf_dir), B_SHORT), "thresholds")
    samples = M.samples_b(spark, sf_dir).unionByName(M.samples_a(spark, sf_dir))
    # the gate and the payload join read the evaluated rows as written once
    return M.written(evaluate(samples, th, messages=True), "status"), th


@register("e2_incidents_per_cluster")
def e2_incidents_per_cluster(spark, sf_dir):
    """E1-E5 of both bridges in one plan, each cluster with its own thresholds and gate."""
    ev, th = _per_cluster(spark, sf_dir)
    return detect(ev, th).select(*DETECT_OUT)


@register("e7_incidents_per_cluster")
def e7_incidents_per_cluster(spark, sf_dir):
    """E6 + E7 with each cluster's own de-duplication window."""
    ev, th = _per_cluster(spark, sf_dir)
    return dedup(event_records(ev, detect(ev, th), th)).select(*EVENT_OUT)


# ---------------------------------------------------------------------------
# Remaining reports: Q2, Q3, Q5, Q6, Q8
# ---------------------------------------------------------------------------
def _glatest_all(spark, sf_dir):
    ga = latest_group_status(M.group_status(M.evaluated_a(spark, sf_dir, A_WEEKLY, messages=False))) \
        .withColumn("member_count", F.lit(0))
    return _glatest_b(spark, sf_dir).unionByName(ga)


@register("q2_cluster_status")
def q2_cluster_status(spark, sf_dir):
    """Q2: all group rows of one cluster."""
    return _group_out(RP.cluster_status(_glatest_all(spark, sf_dir), "orders"))


@register("q3_cluster_groups")
def q3_cluster_groups(spark, sf_dir):
    return RP.cluster_groups(_glatest_all(spark, sf_dir), "events")


@register("q5_all_groups")
def q5_all_groups(spark, sf_dir):
    """Q5: latest status of every group of every cluster."""
    return _group_out(_glatest_all(spark, sf_dir))


@register("q6_group_pairs")
def q6_group_pairs(spark, sf_dir):
    return RP.group_pairs(_glatest_all(spark, sf_dir))


@register("q8_default_cluster_lookup")
def q8_default_cluster_lookup(spark, sf_dir):
    """Q8: legacy single-cluster mode names its cluster 'default'; look up
    every group of Bridge B there plus one unknown group."""
    gl = _glatest_b(spark, sf_dir).withColumn("cluster", F.lit("default"))
    cfg = spark.createDataFrame([("default", True, [], None, 0)], CLUSTER_SCHEMA)
    req = gl.select("cluster", "group_id").unionByName(
        spark.createDataFrame([("default", "missing-group")], "cluster string, group_id string"))
    return RP.group_lookup(gl, cfg, req).select("cluster", "group_id", "outcome", "total_lag")


# ---------------------------------------------------------------------------
# P3 with real gaps: an end-offset read "fails" whenever the partition got no
# new message since the previous tick; those positions are skipped but still
# counted in partition_count.
# ---------------------------------------------------------------------------


def _read_ends(wm):
    """End offsets without those whose partition got no new message."""
    w = _W.partitionBy("cluster", "topic", "partition").orderBy("ts")
    moved = F.coalesce(F.col("high_watermark") > F.lag("high_watermark", 1).over(w), F.lit(True))
    return wm.withColumn("_moved", moved).filter("_moved").drop("_moved")


def _gappy_samples(spark, sf_dir):
    pos, wm = events_samples(spark, sf_dir)
    return join_watermarks(pos, _read_ends(wm))


@register("p3_unreadable_partitions")
def p3_unreadable_partitions(spark, sf_dir):
    ev = evaluate(_gappy_samples(spark, sf_dir), B_LONG, messages=False)
    return _group_out(R.group_status(ev).withColumn("member_count", F.lit(0)))


@register("p3_status_with_gaps")
def p3_status_with_gaps(spark, sf_dir):
    return partition_status(evaluate(_gappy_samples(spark, sf_dir), B_LONG, messages=False)).select(*STATUS_OUT)
