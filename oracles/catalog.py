"""DuckDB twins of the registered queries (see tidewater/plans/catalog.py)."""

from __future__ import annotations

from tidewater.config import A_WEEKLY, B_LONG

from . import duck as D

SQL: dict[str, str] = {}

STATUS_OUT = D.STATUS_OUT


def _groups(src: str, members: str | None) -> str:
    """CTE body: group rollup over evaluated CTE `src`."""
    m = (f"LEFT JOIN {members} m ON m.cluster = g.cluster AND m.group_id = g.group_id" if members else "")
    mc = "CAST(coalesce(m.members, 0) AS INTEGER)" if members else "CAST(0 AS INTEGER)"
    return f"""
SELECT g.cluster, g.group_id, g.ts_us, g.partition_count, g.total_lag, g.active_partitions,
       g.stopped_partitions, g.stalled_partitions, g.lagging_partitions, g.critical_count,
       g.warning_count, g.healthy_count,
       CASE WHEN g.critical_count > 0 THEN 'CRITICAL' WHEN g.warning_count > 0 THEN 'WARNING'
            ELSE 'GOOD' END AS overall_health,
       {mc} AS member_count
FROM (
  SELECT cluster, group_id, ts_us, CAST(count(*) AS INTEGER) AS partition_count,
         CAST(coalesce(sum(current_lag), 0) AS BIGINT) AS total_lag,
         CAST(count(*) FILTER (WHERE status IN ('ACTIVE', 'EMPTY')) AS INTEGER) AS active_partitions,
         CAST(count(*) FILTER (WHERE status = 'STOPPED') AS INTEGER) AS stopped_partitions,
         CAST(count(*) FILTER (WHERE status = 'STALLED') AS INTEGER) AS stalled_partitions,
         CAST(count(*) FILTER (WHERE status = 'LAGGING') AS INTEGER) AS lagging_partitions,
         CAST(count(*) FILTER (WHERE health = 'CRITICAL') AS INTEGER) AS critical_count,
         CAST(count(*) FILTER (WHERE health = 'WARNING') AS INTEGER) AS warning_count,
         CAST(count(*) FILTER (WHERE health = 'GOOD') AS INTEGER) AS healthy_count
  FROM {src} GROUP BY cluster, group_id, ts_us) g {m}"""


MEMBERS_B = """
members_b AS (SELECT cluster, group_id, CAST(count(DISTINCT "partition") AS INTEGER) AS members
              FROM pos_b WHERE committed_offset IS NOT NULL GROUP BY cluster, group_id)"""


def _groups_b_ctes() -> list[str]:
    return [D.bridge_b(), D.evaluate("samples_b", B_LONG, "ev_b"), MEMBERS_B,
            "groups_b AS (" + _groups("ev_b", "members_b") + ")"]


def _groups_a_ctes() -> list[str]:
    return [D.bridge_a(), D.evaluate("samples_a", A_WEEKLY, "ev_a"),
            "groups_a AS (" + _groups("ev_a", None) + ")"]


SQL["w_status_events"] = D.with_(D.bridge_b(), D.evaluate("samples_b", B_LONG, "ev_b")) + \
    f"\nSELECT {STATUS_OUT} FROM ev_b"
SQL["w_status_orders"] = D.with_(D.bridge_a(), D.evaluate("samples_a", A_WEEKLY, "ev_a")) + \
    f"\nSELECT {STATUS_OUT} FROM ev_a"
SQL["a1_group_status_events"] = D.with_(*_groups_b_ctes()) + "\nSELECT * FROM groups_b"
SQL["a3_health_partitions"] = D.with_(D.bridge_b(), D.evaluate("samples_b", B_LONG, "ev_b")) + """
SELECT cluster, group_id, ts_us, topic, "partition", status, health, lag_trend, current_lag, current_offset,
       high_watermark, consumption_rate, lag_change_rate
FROM ev_b WHERE health IN ('CRITICAL', 'WARNING', 'GOOD')"""
SQL["a1_group_status_orders"] = D.with_(*_groups_a_ctes()) + "\nSELECT * FROM groups_a"

SQL["t1_worst_groups"] = D.with_(*_groups_b_ctes(), *_groups_a_ctes(), """
allg AS (SELECT * FROM groups_a UNION ALL SELECT * FROM groups_b),
latest AS (SELECT * FROM allg QUALIFY row_number() OVER (PARTITION BY cluster, group_id ORDER BY ts_us DESC) = 1)""") + """
SELECT *, CAST(CASE overall_health WHEN 'GOOD' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 ELSE -1 END AS INTEGER)
       AS health_code
FROM latest ORDER BY health_code DESC, total_lag DESC, cluster, group_id LIMIT 10"""

# --- incident events -------------------------------------------------------
from tidewater.config import B_SHORT  # noqa: E402
from tidewater.schemas import DEFAULT_EVENT_SOURCE, YEAR_ONE_OFFSET_S  # noqa: E402

DETECT_OUT = 'cluster, group_id, topic, "partition", ts_us, event_type, severity'


def _detect_sql(bridge: str, src: str, th) -> str:
    return D.with_(bridge, D.evaluate(src, th, "ev"), D.detect("ev", th, "det")) + f"\nSELECT {DETECT_OUT} FROM det"


SQL["e2_incidents_events_long"] = _detect_sql(D.bridge_b(), "samples_b", B_LONG)
SQL["e2_incidents_events_short"] = _detect_sql(D.bridge_b(), "samples_b", B_SHORT)
SQL["e2_incidents_orders"] = _detect_sql(D.bridge_a(), "samples_a", A_WEEKLY)


def _records_sql(th, source: str = DEFAULT_EVENT_SOURCE) -> str:
    """CTE `recs`: E6 records with fingerprint and deterministic id over `det` + `ev`."""
    w_us = int(round(th.dedup_s * 1_000_000))
    y1 = YEAR_ONE_OFFSET_S * 1_000_000
    bucket = f"(CAST(((d.ts_us + {y1}) - (((d.ts_us + {y1}) % {w_us}) + {w_us}) % {w_us}) // 1000000 AS BIGINT) - {YEAR_ONE_OFFSET_S})"
    return f"""
recs0 AS (
  SELECT d.*, e.current_lag, e.current_offset, e.high_watermark, e.consumption_rate, e.lag_change_rate,
         {bucket} AS dedup_bucket_s
  FROM det d JOIN ev e ON e.cluster = d.cluster AND e.group_id = d.group_id AND e.topic = d.topic
       AND e."partition" = d."partition" AND e.ts_us = d.ts_us AND e.kind = 'window'),
recs1 AS (
  SELECT *, md5(concat_ws(':', '{source}', event_type, group_id, topic, CAST("partition" AS VARCHAR),
                          CAST(dedup_bucket_s AS VARCHAR))) AS fingerprint
  FROM recs0),
recs AS (
  SELECT md5(concat_ws('|', fingerprint, CAST(ts_us AS VARCHAR), cluster)) AS id, '{source}' AS source,
         event_type AS type, severity, ts_us, cluster,
         printf('Kafka Consumer %s: %s', event_type, group_id) AS title, fingerprint,
         group_id AS consumer_group, topic, "partition", current_lag, current_offset, high_watermark,
         CAST(0 AS BIGINT) AS lag_delta, CAST(0 AS BIGINT) AS offset_delta, consumption_rate,
         lag_change_rate, dedup_bucket_s
  FROM recs1)"""


SQL["e7_events_dedup"] = D.with_(D.bridge_b(), D.evaluate("samples_b", B_SHORT, "ev"),
                                 D.detect("ev", B_SHORT, "det"), _records_sql(B_SHORT)) + """
SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts_us, cluster, id) = 1"""

_WEEK = B_SHORT.with_(dedup_s=7 * 86400.0)
SQL["e7_events_dedup_week"] = D.with_(D.bridge_b(), D.evaluate("samples_b", _WEEK, "ev"),
                                      D.detect("ev", _WEEK, "det"), _records_sql(_WEEK)) + """
SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts_us, cluster, id) = 1"""
SQL["e7_orders_dedup"] = D.with_(D.bridge_a(), D.evaluate("samples_a", A_WEEKLY, "ev"),
                                 D.detect("ev", A_WEEKLY, "det"), _records_sql(A_WEEKLY)) + """
SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts_us, cluster, id) = 1"""

# --- scans, latest rows, rollups, reports, metrics -------------------------
B_EV = [D.bridge_b(), D.evaluate("samples_b", B_LONG, "ev_b")]
LATEST_B = """
latest_b AS (SELECT * FROM ev_b WHERE kind <> 'unreadable'
             QUALIFY row_number() OVER (PARTITION BY cluster, group_id, topic, "partition" ORDER BY ts_us DESC) = 1)"""
GLATEST_B = """
glatest_b AS (SELECT * FROM groups_b QUALIFY row_number() OVER (PARTITION BY cluster, group_id ORDER BY ts_us DESC) = 1)"""
GLATEST_A = """
glatest_a AS (SELECT * FROM groups_a QUALIFY row_number() OVER (PARTITION BY cluster, group_id ORDER BY ts_us DESC) = 1)"""
CLUSTERS = """
cfg AS (
  SELECT name, enabled, brokers, ordinal FROM (
    SELECT DISTINCT cluster AS name, true AS enabled,
           [cluster || '-broker-1:9092', cluster || '-broker-2:9092'] AS brokers,
           CASE WHEN cluster = 'orders' THEN 1 ELSE 0 END AS ordinal
    FROM (SELECT cluster FROM samples_b UNION ALL SELECT cluster FROM samples_a))
  UNION ALL SELECT 'orders', true, ['dup-broker:9092'], 5
  UNION ALL SELECT 'archive', false, ['old:9092'], 6)"""

SQL["s1_positions"] = D.with_(D.bridge_b()) + '\nSELECT cluster, group_id, topic, "partition", ts_us, committed_offset FROM pos_b'
SQL["s2_watermarks"] = D.with_(D.bridge_b()) + '\nSELECT cluster, topic, "partition", ts_us, high_watermark FROM wm_b'
SQL["s3_group_roster"] = D.with_(D.bridge_b(), D.bridge_a()) + """
SELECT DISTINCT cluster, group_id FROM (SELECT cluster, group_id FROM pos_b UNION ALL SELECT cluster, group_id FROM samples_a)"""

_A_AS_B = A_WEEKLY  # 'orders' override
SQL["s4_thresholds_per_cluster"] = D.with_(D.bridge_b(), D.bridge_a(), D.evaluate("samples_b", B_LONG, "ev_b"),
                                           D.evaluate("samples_a", A_WEEKLY, "ev_a")) + f"""
SELECT cluster, kind, status, count(*) AS "rows",
       CAST(CASE WHEN cluster = 'orders' THEN {A_WEEKLY.window_size} ELSE {B_LONG.window_size} END AS INTEGER) AS window_size,
       CASE WHEN cluster = 'orders' THEN {A_WEEKLY.inactivity_s!r} ELSE {B_LONG.inactivity_s!r} END AS inactivity_s
FROM (SELECT cluster, kind, status FROM ev_b UNION ALL SELECT cluster, kind, status FROM ev_a)
GROUP BY cluster, kind, status"""

SQL["p4_latest_per_key"] = D.with_(*B_EV, LATEST_B) + f"\nSELECT {STATUS_OUT} FROM latest_b"
SQL["a6_latest_group_status"] = D.with_(*_groups_b_ctes(), GLATEST_B) + "\nSELECT * FROM glatest_b"
SQL["a7_groups_per_cluster"] = D.with_(*_groups_b_ctes(), *_groups_a_ctes(), GLATEST_B, GLATEST_A) + """
SELECT cluster, count(DISTINCT group_id) AS groups FROM (SELECT cluster, group_id FROM glatest_b UNION ALL
  SELECT cluster, group_id FROM glatest_a) GROUP BY cluster"""

_buckets = [3600.0 * h for h in (1, 2, 3, 6, 12, 24)]
_le = ",\n".join(f"  SELECT cluster, group_id, \"count\", \"sum\", '{b}' AS le, n{i} AS n FROM h"
                 for i, b in enumerate(_buckets))
SQL["a9_idle_histogram"] = D.with_(*B_EV, "h AS (SELECT cluster, group_id, count(*) AS \"count\", "
                                   "sum(time_since_last_move_s) AS \"sum\", "
                                   + ", ".join(f"CAST(sum(CASE WHEN time_since_last_move_s <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS n{i}"
                                               for i, b in enumerate(_buckets))
                                   + " FROM ev_b WHERE kind <> 'unreadable' GROUP BY cluster, group_id)") + "\n" + \
    "\nUNION ALL\n".join(f"SELECT cluster, group_id, \"count\", \"sum\", '{b}' AS le, n{i} AS n FROM h"
                         for i, b in enumerate(_buckets)) + \
    "\nUNION ALL\nSELECT cluster, group_id, \"count\", \"sum\", '+Inf' AS le, \"count\" AS n FROM h"

SQL["a12_lag_by_group"] = D.with_(*B_EV, LATEST_B) + """
SELECT cluster, group_id, CAST(sum(current_lag) AS BIGINT) AS total_lag FROM latest_b GROUP BY cluster, group_id"""
SQL["a13_lag_over_time"] = D.with_(*B_EV, """
pt AS (SELECT cluster, group_id, ts_us, CAST(sum(current_lag) AS BIGINT) AS lag FROM ev_b
       WHERE kind <> 'unreadable' GROUP BY cluster, group_id, ts_us)""") + """
SELECT *, arg_max(lag, ts_us) OVER (PARTITION BY cluster, group_id) AS "last",
       max(lag) OVER (PARTITION BY cluster, group_id) AS "max" FROM pt"""
SQL["a14_status_code_counts"] = D.with_(*B_EV, LATEST_B, """
codes AS (SELECT CAST(unnest([-1, 0, 1, 2, 3, 4]) AS INTEGER) AS status_code),
c AS (SELECT CAST(CASE status WHEN 'ACTIVE' THEN 0 WHEN 'LAGGING' THEN 1 WHEN 'STALLED' THEN 2
                   WHEN 'STOPPED' THEN 3 WHEN 'EMPTY' THEN 4 ELSE -1 END AS INTEGER) AS status_code,
             count(*) AS partitions FROM latest_b GROUP BY 1)""") + """
SELECT codes.status_code, CAST(coalesce(c.partitions, 0) AS BIGINT) AS partitions
FROM codes LEFT JOIN c ON c.status_code = codes.status_code"""
SQL["a15_label_values"] = D.with_(*B_EV, LATEST_B) + """
SELECT DISTINCT 'group_id' AS label, group_id AS value FROM latest_b
UNION ALL SELECT DISTINCT 'topic', topic FROM latest_b WHERE group_id IN ('click', 'view')"""

SQL["q1_clusters"] = D.with_(*_groups_b_ctes(), *_groups_a_ctes(), GLATEST_B, GLATEST_A, CLUSTERS, """
gc AS (SELECT cluster, count(*) AS groups FROM (SELECT cluster FROM glatest_b UNION ALL SELECT cluster FROM glatest_a)
       GROUP BY cluster)""") + """
SELECT name, enabled, CAST(len(brokers) AS INTEGER) AS brokers, CAST(coalesce(gc.groups, 0) AS BIGINT) AS groups,
       CAST(NULL AS VARCHAR) AS last_error
FROM cfg LEFT JOIN gc ON gc.cluster = cfg.name"""
SQL["q4_group_lookup"] = D.with_(*_groups_b_ctes(), D.bridge_a(), GLATEST_B, CLUSTERS, """
req AS (SELECT cluster, group_id FROM glatest_b UNION ALL SELECT 'events', 'no/such-group'
        UNION ALL SELECT 'nowhere', 'click'),
known AS (SELECT DISTINCT name AS cluster FROM cfg WHERE enabled)""") + """
SELECT r.cluster, r.group_id,
       CASE WHEN k.cluster IS NULL THEN 'cluster_not_found' WHEN g.ts_us IS NULL THEN 'group_not_found'
            ELSE 'found' END AS outcome, g.total_lag, g.overall_health
FROM req r LEFT JOIN known k ON k.cluster = r.cluster
LEFT JOIN glatest_b g ON g.cluster = r.cluster AND g.group_id = r.group_id"""
SQL["q7_readiness"] = D.with_(*_groups_b_ctes(), D.bridge_a(), GLATEST_B, CLUSTERS, """
per AS (SELECT c.name AS cluster, (SELECT count(*) FROM glatest_b g WHERE g.cluster = c.name) AS g
        FROM (SELECT DISTINCT name FROM cfg WHERE enabled) c)""") + """
SELECT count(*) FILTER (WHERE g > 0) > 0 AS ready, count(*) AS clusters_total,
       count(*) FILTER (WHERE g > 0) AS clusters_ready,
       CASE WHEN count(*) = 0 THEN 'no_clusters_configured'
            WHEN count(*) FILTER (WHERE g > 0) = 0 THEN 'no_ready_clusters' END AS reason
FROM per"""
SQL["q9_overview"] = D.with_(*_groups_b_ctes(), GLATEST_B) + """
SELECT cluster, group_id, overall_health AS status,
       CAST(CASE overall_health WHEN 'GOOD' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 ELSE -1 END AS INTEGER) AS status_code,
       total_lag, critical_count AS error_partitions, warning_count AS warning_partitions
FROM glatest_b ORDER BY total_lag DESC, cluster, group_id"""
SQL["q10_partition_series"] = D.with_(*B_EV) + """
SELECT topic, "partition", ts_us, current_lag AS lag FROM ev_b
WHERE kind <> 'unreadable' AND cluster = 'events' AND group_id = 'purchase'"""
_STC = ("CAST(CASE status WHEN 'ACTIVE' THEN 0 WHEN 'LAGGING' THEN 1 WHEN 'STALLED' THEN 2 WHEN 'STOPPED' THEN 3 "
        "WHEN 'EMPTY' THEN 4 ELSE -1 END AS INTEGER)")
_TRC = "CAST(CASE lag_trend WHEN 'STABLE' THEN 1 WHEN 'INCREASING' THEN 2 WHEN 'DECREASING' THEN 3 ELSE 0 END AS INTEGER)"
_HLC = "CAST(CASE health WHEN 'GOOD' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 ELSE -1 END AS INTEGER)"
SQL["q11_partition_detail"] = D.with_(*B_EV, LATEST_B, f"""
d AS (SELECT cluster, group_id, topic, "partition", current_lag, {_STC} AS status_code, {_TRC} AS trend_code,
             {_HLC} AS health_code FROM latest_b)""") + """
SELECT *, CASE status_code WHEN 0 THEN 'Active' WHEN 1 THEN 'Lagging' WHEN 2 THEN 'Stalled' WHEN 3 THEN 'Stopped'
                           WHEN 4 THEN 'Empty' WHEN -1 THEN 'Unknown' END AS status_label,
          CASE trend_code WHEN 1 THEN 'Stable' WHEN 2 THEN 'Increasing' WHEN 3 THEN 'Decreasing' WHEN 0 THEN 'Unknown' END AS trend_label,
          CASE health_code WHEN 0 THEN 'Good' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Critical' WHEN -1 THEN 'Unknown' END AS health_label
FROM d WHERE regexp_full_match(CAST(status_code AS VARCHAR), '[1-4]')"""
SQL["t1_top_groups_by_lag"] = D.with_(*_groups_b_ctes(), *_groups_a_ctes(), GLATEST_B, GLATEST_A) + """
SELECT cluster, group_id, total_lag FROM (SELECT cluster, group_id, total_lag FROM glatest_b UNION ALL
  SELECT cluster, group_id, total_lag FROM glatest_a) ORDER BY total_lag DESC, cluster, group_id LIMIT 10"""
SQL["p7_ready_groups"] = D.with_(*B_EV) + """
SELECT cluster, group_id, max(window_completeness) AS max_completeness, max(window_completeness) >= 80.0 AS ready
FROM ev_b WHERE kind <> 'unreadable' GROUP BY cluster, group_id"""
SQL["j4_merge_series"] = D.with_(*_groups_b_ctes()) + """
SELECT cluster, group_id,
       CAST(arg_max(CASE WHEN critical_count > 0 THEN critical_count END, CASE WHEN critical_count > 0 THEN ts_us END) AS INTEGER) AS error_partitions,
       arg_max(total_lag, ts_us) AS total_lag
FROM groups_b GROUP BY cluster, group_id"""

_PG = [("consumer_lag", "current_lag"), ("consumer_current_offset", "current_offset"),
       ("consumer_status", _STC), ("consumer_lag_trend", _TRC), ("consumer_health", _HLC),
       ("consumer_consumption_rate", "consumption_rate"), ("consumer_lag_change_rate", "lag_change_rate"),
       ("consumer_time_since_last_activity_seconds", "time_since_last_move_s")]
_GG = [("consumer_group_health",
        "CASE overall_health WHEN 'GOOD' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 ELSE -1 END"),
       ("consumer_group_total_lag", "total_lag"), ("consumer_group_active_partitions", "active_partitions"),
       ("consumer_group_stopped_partitions", "stopped_partitions"),
       ("consumer_group_stalled_partitions", "stalled_partitions"), ("consumer_group_members", "member_count")]
SQL["s8_metrics_long"] = D.with_(*_groups_b_ctes(), GLATEST_B, """
lw AS (SELECT * FROM ev_b WHERE kind = 'window'
       QUALIFY row_number() OVER (PARTITION BY cluster, group_id, topic, "partition" ORDER BY ts_us DESC) = 1),
act AS (SELECT cluster, group_id, topic, "partition", max(CASE WHEN is_active THEN ts_us END) AS la
        FROM ev_b WHERE kind = 'window' GROUP BY ALL),
le AS (SELECT cluster, topic, "partition", arg_max(high_watermark, (ts_us, high_watermark)) AS v
       FROM ev_b WHERE kind = 'window' GROUP BY ALL)""") + "\n" + "\nUNION ALL ".join(
    [f"SELECT '{m}' AS metric, cluster, group_id, topic, \"partition\", CAST({e} AS DOUBLE) AS value FROM lw"
     for m, e in _PG]
    + ["SELECT 'consumer_last_activity_timestamp', cluster, group_id, topic, \"partition\", "
       "CAST(floor(la / 1000000) AS DOUBLE) FROM act WHERE la IS NOT NULL",
       "SELECT 'consumer_log_end_offset', cluster, NULL, topic, \"partition\", CAST(v AS DOUBLE) FROM le"]
    + [f"SELECT '{m}', cluster, group_id, NULL, NULL, CAST({e} AS DOUBLE) FROM glatest_b" for m, e in _GG])

SQL["x8_key_text"] = D.with_(D.bridge_b()) + """
SELECT cluster || '/' || group_id || '/v1' AS key, cluster, group_id || '/v1' AS group_id
FROM (SELECT DISTINCT cluster, group_id FROM pos_b)"""

_DET_S = [D.bridge_b(), D.evaluate("samples_b", B_SHORT, "ev"), D.detect("ev", B_SHORT, "det")]
SQL["a11_event_counts"] = D.with_(*_DET_S) + "\nSELECT event_type AS type, count(*) AS events FROM det GROUP BY 1"
SQL["a11_first_events"] = D.with_(*_DET_S) + """
SELECT event_type AS type, CAST(rank AS INTEGER) AS rank, cluster, group_id, topic, "partition", ts_us FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_us, cluster, group_id, topic, "partition") AS rank
  FROM det) WHERE rank <= 3"""
SQL["j6_missing_event_types"] = D.with_(D.bridge_b(), D.evaluate("samples_b", B_LONG, "ev"), D.detect("ev", B_LONG, "det")) + """
SELECT type FROM (SELECT unnest(['consumer_stopped', 'consumer_stalled', 'rapid_lag_increase', 'consumer_recovered',
  'lag_cleared']) AS type) WHERE type NOT IN (SELECT event_type FROM det)"""
SQL["x10_log_lines"] = D.with_(*_DET_S) + """
SELECT d.cluster, d.group_id, d.topic, d."partition", d.ts_us,
       printf('[EVENT] Type: %s, Severity: %s, Lag: %d', d.event_type, d.severity, e.current_lag) AS line
FROM det d JOIN ev e ON e.cluster = d.cluster AND e.group_id = d.group_id AND e.topic = d.topic
  AND e."partition" = d."partition" AND e.ts_us = d.ts_us AND e.kind = 'window'"""

# --- placement and membership ----------------------------------------------
PL_BASE = """
pk AS (SELECT DISTINCT 'user-' || CAST(user_id AS VARCHAR) AS key FROM events),
pm AS (SELECT 'inst-' || lower(n_name) AS member FROM nation),
owners AS (SELECT CAST(b AS INTEGER) AS bucket, arg_max(member, md5(CAST(b AS VARCHAR) || '|' || member)) AS owner
           FROM pm, (SELECT unnest(range(0, 997)) AS b) GROUP BY b),
owners2 AS (SELECT CAST(b AS INTEGER) AS bucket, arg_max(member, md5(CAST(b AS VARCHAR) || '|' || member)) AS owner
            FROM (SELECT * FROM pm WHERE member <> 'inst-algeria'), (SELECT unnest(range(0, 997)) AS b) GROUP BY b),
kb AS (SELECT key, CAST(('0x' || substr(md5(key), 1, 8))::BIGINT % 997 AS INTEGER) AS bucket FROM pk),
asg AS (SELECT key, kb.bucket, owner FROM kb JOIN owners USING (bucket)),
asg2 AS (SELECT key, kb.bucket, owner FROM kb JOIN owners2 USING (bucket))"""
SQL["k1_key_buckets"] = D.with_(PL_BASE) + "\nSELECT key, bucket FROM kb"
SQL["k2_bucket_owners"] = D.with_(PL_BASE) + "\nSELECT bucket, owner FROM owners"
SQL["k3_assignments"] = D.with_(PL_BASE) + "\nSELECT pm.member, asg.key FROM pm LEFT JOIN asg ON asg.owner = pm.member"
SQL["k4_load_report"] = D.with_(PL_BASE, """
per AS (SELECT pm.member, CAST(count(asg.key) AS BIGINT) AS keys FROM pm LEFT JOIN asg ON asg.owner = pm.member
        GROUP BY pm.member)""") + """
SELECT member, keys, (sum(keys) OVER () / count(*) OVER ()) * 1.25 AS "limit",
       keys > (sum(keys) OVER () / count(*) OVER ()) * 1.25 AS over_limit FROM per"""
SQL["k5_churn"] = D.with_(PL_BASE) + """
SELECT count(*) AS keys, count(*) FILTER (WHERE NOT coalesce(a.owner = b.owner, false)) AS moved
FROM asg a FULL OUTER JOIN asg2 b ON a.key = b.key"""
HB = """
hb AS (SELECT 'inst-' || lower(n.n_name) AS id, epoch_us(o.o_orderdate) AS ts_us,
              CASE WHEN o.o_orderstatus = 'P' THEN 'offline' ELSE 'active' END AS status, o.o_orderkey AS assigned_count
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
now_ AS (SELECT max(ts_us) AS now FROM hb),
cur AS (SELECT id, arg_max(ts_us, (ts_us, status, assigned_count)) AS last_heartbeat_us, arg_max(status, (ts_us, status, assigned_count)) AS status,
               arg_max(assigned_count, (ts_us, status, assigned_count)) AS assigned_count FROM hb GROUP BY id),
cur2 AS (SELECT * FROM cur WHERE (SELECT now FROM now_) - last_heartbeat_us <
         CASE WHEN status = 'offline' THEN 604800.0 ELSE 2592000.0 END * 1000000)"""
SQL["l2_current_members"] = D.with_(HB) + "\nSELECT id, last_heartbeat_us, status, assigned_count FROM cur2"
SQL["l1_active_members"] = D.with_(HB) + """
SELECT id, last_heartbeat_us, status FROM cur2
WHERE status = 'active' AND (SELECT now FROM now_) - last_heartbeat_us < 1209600.0 * 1000000"""

# --- event sink / retention / consumption ------------------------------------
_RECS = [D.bridge_b(), D.evaluate("samples_b", B_SHORT, "ev"), D.detect("ev", B_SHORT, "det"),
         _records_sql(B_SHORT),
         "rd AS (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts_us, cluster, id) = 1)"]
SQL["s5_event_envelope"] = D.with_(*_RECS) + """
SELECT type, severity, cluster, consumer_group AS group_id, topic, CAST("partition" AS VARCHAR) AS "partition",
       CAST(floor(ts_us / 1000000) AS BIGINT) AS "timestamp", fingerprint, current_lag FROM rd"""
SQL["s6_retain_latest"] = D.with_(*_RECS) + """
SELECT id, ts_us, type, consumer_group AS group_id, "partition" FROM rd ORDER BY ts_us DESC, id DESC LIMIT 100"""
SQL["c1_parse_accepted"] = D.with_(*_RECS) + """
SELECT id, type, severity, cluster, consumer_group, topic, "partition", current_lag, fingerprint FROM rd
WHERE substr(fingerprint, 1, 1) NOT IN ('0', '1')"""
SQL["c2_quarantine"] = D.with_(*_RECS) + """
SELECT consumer_group AS group_id, topic, CAST("partition" AS VARCHAR) AS "partition",
       CAST(floor(ts_us / 1000000) AS BIGINT) AS "timestamp",
       CASE WHEN substr(fingerprint, 1, 1) = '1' THEN 'missing payload' ELSE 'invalid payload' END AS reject_reason
FROM rd WHERE substr(fingerprint, 1, 1) IN ('0', '1')"""

# --- streaming = batch ---------------------------------------------------------
SQL["st2_stream_equals_batch"] = D.with_(D.bridge_b(), D.evaluate("samples_b", B_SHORT, "ev_b")) + \
    f"\nSELECT {STATUS_OUT} FROM ev_b"
SQL["st3_stream_events"] = _detect_sql(D.bridge_b(), "samples_b", B_SHORT)

SQL["st3_stream_hot_split"] = SQL["st3_stream_events"]

# --- rows of one key and time: four ticks fall together, in order of arrival -------


def _same_times(th) -> list[str]:
    rows = f"same_times AS (SELECT * REPLACE (ts_us - ts_us % {4 * D.HOUR_US} AS ts_us), ts_us AS seq FROM samples_b)"
    tie = f"row_number() OVER (PARTITION BY {D.KEYC}, kind, ts_us ORDER BY seq)"
    return [D.bridge_b(), rows, D.evaluate("same_times", th, "ev", "ts_us, seq", f", CAST({tie} - 1 AS INTEGER) AS tie")]


SQL["w1_same_times"] = SQL["w1_same_times_hot_split"] = D.with_(*_same_times(B_LONG)) + f"\nSELECT {STATUS_OUT}, tie FROM ev"
SQL["e2_same_times"] = D.with_(*_same_times(B_LONG), D.detect("ev", B_LONG, "det", "tie")) + f"""
SELECT {DETECT_OUT}, tie, current_offset
FROM det JOIN (SELECT cluster, group_id, topic, "partition", ts_us, tie, current_offset FROM ev WHERE kind = 'window')
USING (cluster, group_id, topic, "partition", ts_us, tie)"""
SQL["st7_same_times_stream"] = D.with_(*_same_times(B_SHORT), D.detect("ev", B_SHORT, "det", "tie")) + f"\nSELECT {DETECT_OUT} FROM det"

SQL["s1_scan_aligned"] = SQL["w_status_events"]
SQL["e8_disabled_publisher"] = f"SELECT * FROM ({SQL['e7_events_dedup']}) WHERE false"
SQL["l3_read_assignments"] = D.with_(PL_BASE) + """
SELECT asg.owner AS member, asg.key FROM asg JOIN kb ON kb.key = asg.key WHERE kb.bucket % 10 <> 0"""
SQL["l3_stale_assignments"] = D.with_(PL_BASE) + "\nSELECT owner AS member, key FROM asg WHERE false"
SQL["a8_error_counts"] = D.with_(*_RECS) + """
SELECT cluster, count(*) AS errors FROM rd WHERE substr(fingerprint, 1, 1) IN ('0', '1') GROUP BY cluster"""
SQL["a10_last_duration"] = D.with_(*B_EV) + """
SELECT cluster, arg_max(d, ts_us) AS duration_s FROM (
  SELECT cluster, ts_us, max(time_since_last_move_s) AS d FROM ev_b WHERE kind <> 'unreadable' GROUP BY cluster, ts_us)
GROUP BY cluster"""
SQL["c2_stream_quarantine"] = SQL["c2_quarantine"]
SQL["st4_stream_dedup"] = SQL["e7_events_dedup_week"]
SQL["st5_state_after_late_batch"] = SQL["st2_stream_equals_batch"]
SQL["st7_late_rows"] = D.with_(D.bridge_b()) + """
SELECT cluster, group_id, topic, "partition", ts_us, committed_offset, high_watermark
FROM samples_b, (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM samples_b)
WHERE floor((ts_us - lo) * 3 / (hi - lo + 1)) = 0"""

# --- keyed streaming state -----------------------------------------------------
SQL["st2_keyed_windows"] = SQL["st2_stream_equals_batch"]
SQL["st3_keyed_gate"] = SQL["s10_restart"] = SQL["e2_incidents_events_short"]
SQL["s7_consumer_groups"] = D.with_(*_RECS) + """
SELECT consumer, row_number() OVER (PARTITION BY consumer ORDER BY ts_us, id) AS seq, id, ts_us, type,
       consumer_group AS group_id, topic, "partition"
FROM rd, (SELECT unnest(['audit', 'alerts']) AS consumer)"""
SQL["s6_retained_versions"] = SQL["s6_retain_latest"].replace("LIMIT 100", "LIMIT 1000")
SQL["a8_cumulative_errors"] = SQL["a8_error_counts"]
_default = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0", "+Inf"]
SQL["a9_cumulative_histogram"] = D.with_(*B_EV, """
idle AS (SELECT cluster, group_id, time_since_last_move_s / 3600 AS d FROM ev_b WHERE kind <> 'unreadable'),
les AS (SELECT unnest([""" + ", ".join(f"'{b}'" for b in _default) + """]) AS le)""") + """
SELECT cluster, group_id, count(*) AS "count", sum(d) AS "sum", le,
       count(*) FILTER (WHERE le = '+Inf' OR d <= TRY_CAST(le AS DOUBLE)) AS n
FROM idle, les GROUP BY cluster, group_id, le"""
SQL["a7_groups_by_sketch"] = D.with_(D.bridge_b(), D.bridge_a()) + """
SELECT cluster, count(DISTINCT group_id) AS groups FROM (SELECT cluster, group_id FROM samples_b UNION ALL
  SELECT cluster, group_id FROM samples_a) GROUP BY cluster"""
SQL["e8_publish_outcomes"] = D.with_(D.bridge_b(), D.evaluate("samples_b", B_SHORT, "ev_b"),
                                     D.attempts("ev_b", B_SHORT.with_(dedup_s=7 * 86400.0), "att")) + """
SELECT cluster, group_id, topic, "partition", ts_us, ev, event_type, severity, outcome FROM att"""

# --- window snapshots -------------------------------------------------------------
SNAP = """
win AS (SELECT * FROM samples_b WHERE committed_offset IS NOT NULL AND high_watermark IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cluster, group_id, topic, "partition" ORDER BY ts_us DESC) <= 10),
snap AS (SELECT cluster, group_id, topic, "partition",
                list({'ts_us': ts_us, 'committed_offset': committed_offset, 'high_watermark': high_watermark,
                      'lag': lag} ORDER BY ts_us) AS records,
                (SELECT max(ts_us) FROM samples_b) AS saved_at_us
         FROM win GROUP BY cluster, group_id, topic, "partition")"""
SQL["s9_save_windows"] = D.with_(D.bridge_b(), SNAP) + """
SELECT cluster, group_id, topic, "partition", CAST(len(records) AS INTEGER) AS records,
       records[1].ts_us AS first_ts_us, records[-1].committed_offset AS last_offset, saved_at_us FROM snap"""
SQL["s10_load_windows"] = D.with_(D.bridge_b(), SNAP) + """
SELECT cluster, group_id, topic, "partition", r.ts_us, r.committed_offset, r.high_watermark, r.lag
FROM (SELECT cluster, group_id, topic, "partition", unnest(records) AS r FROM snap)"""
SQL["p6_active_windows"] = D.with_(*_groups_b_ctes(), GLATEST_B, SNAP) + """
SELECT cluster, group_id, topic, "partition", saved_at_us FROM snap
WHERE (cluster, group_id) IN (SELECT cluster, group_id FROM glatest_b WHERE active_partitions > 0)"""
SQL["w_status_events_hot_split"] = SQL["w_status_events"]
SQL["e2_incidents_hot_split"] = SQL["e2_incidents_events_long"]
SQL["w_status_auto_split"] = SQL["w_status_events"]
SQL["e2_incidents_auto_split"] = SQL["e2_incidents_events_long"]
SQL["e2_incidents_per_cluster"] = (
    f"SELECT * FROM ({SQL['e2_incidents_events_short']}) UNION ALL SELECT * FROM ({SQL['e2_incidents_orders']})")
SQL["e7_incidents_per_cluster"] = (
    f"SELECT * FROM ({SQL['e7_events_dedup']}) UNION ALL SELECT * FROM ({SQL['e7_orders_dedup']})")

# --- remaining reports ----------------------------------------------------------
_ALL = [*_groups_b_ctes(), *_groups_a_ctes(), GLATEST_B, GLATEST_A,
        "gall AS (SELECT * FROM glatest_b UNION ALL SELECT * FROM glatest_a)"]
SQL["q2_cluster_status"] = D.with_(*_ALL) + "\nSELECT * FROM gall WHERE cluster = 'orders'"
SQL["q3_cluster_groups"] = D.with_(*_ALL) + "\nSELECT cluster, group_id FROM gall WHERE cluster = 'events'"
SQL["q5_all_groups"] = D.with_(*_ALL) + "\nSELECT * FROM gall"
SQL["q6_group_pairs"] = D.with_(*_ALL) + "\nSELECT DISTINCT cluster, group_id FROM gall"
SQL["q8_default_cluster_lookup"] = D.with_(*_groups_b_ctes(), GLATEST_B) + """
SELECT 'default' AS cluster, group_id, 'found' AS outcome, total_lag FROM glatest_b
UNION ALL SELECT 'default', 'missing-group', 'group_not_found', CAST(NULL AS BIGINT)"""

# --- P3 with watermark gaps ---------------------------------------------------------
def _gappy_b() -> str:
    """bridge_b with wm_b/samples_b replaced by a gappy variant (samples_g)."""
    return D.bridge_b() + """,
wm_g AS (SELECT * FROM wm_b QUALIFY coalesce(high_watermark > lag(high_watermark, 1) OVER
           (PARTITION BY cluster, topic, "partition" ORDER BY ts_us), true)),
samples_g AS (
  SELECT p.cluster, p.group_id, p.topic, p."partition", p.ts_us, p.committed_offset, w.high_watermark,
         CASE WHEN w.high_watermark IS NOT NULL AND p.committed_offset IS NOT NULL
              THEN greatest(w.high_watermark - p.committed_offset, 0) END AS lag
  FROM pos_b p LEFT JOIN wm_g w
    ON w.cluster = p.cluster AND w.topic = p.topic AND w."partition" = p."partition" AND w.ts_us = p.ts_us)"""


SQL["p3_unreadable_partitions"] = D.with_(_gappy_b(), D.evaluate("samples_g", B_LONG, "ev_g"),
                                          "groups_g AS (" + _groups("ev_g", None) + ")") + "\nSELECT * FROM groups_g"
SQL["p3_status_with_gaps"] = D.with_(_gappy_b(), D.evaluate("samples_g", B_LONG, "ev_g")) + \
    f"\nSELECT {STATUS_OUT} FROM ev_g WHERE kind <> 'unreadable'"
SQL["j1_stream_joined_status"] = SQL["p3_status_with_gaps"]

# --- keyed streaming state with a time to live ---------------------------------
#: keys that report only when readable; a silence of more than two hours makes another key of them
STRETCHES = f"""
readable AS (SELECT * FROM samples_g WHERE high_watermark IS NOT NULL),
gaps AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {D.KEYC} ORDER BY ts_us) > {2 * D.HOUR_US} THEN 1 ELSE 0 END AS g
         FROM readable),
stretches AS (SELECT * EXCLUDE (topic, g), topic || '#' || CAST(sum(g) OVER (PARTITION BY {D.KEYC} ORDER BY ts_us) AS VARCHAR) AS topic
              FROM gaps)"""
SQL["st5_keyed_ttl_status"] = D.with_(_gappy_b(), STRETCHES, D.evaluate("stretches", B_SHORT, "ev_s")) + \
    f"\nSELECT * REPLACE (split_part(topic, '#', 1) AS topic) FROM (SELECT {STATUS_OUT} FROM ev_s)"
SQL["st5_keyed_ttl_events"] = D.with_(_gappy_b(), STRETCHES, D.evaluate("stretches", B_SHORT, "ev_s"), D.detect("ev_s", B_SHORT, "det")) + """
SELECT cluster, group_id, split_part(topic, '#', 1) AS topic, "partition", ts_us, event_type, severity FROM det"""
