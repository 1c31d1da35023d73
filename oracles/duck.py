"""DuckDB oracle SQL, built from CTE fragments.

Each registered Spark query has an independent plain-SQL twin here.  The
views `events`, `lineitem`, `orders`, `customer`, ... are registered by the
checker.  Thresholds are inlined as literals.
"""

from __future__ import annotations

from tidewater.config import Thresholds

KEYC = "cluster, group_id, topic, \"partition\""
HOUR_US = 3_600_000_000
WEEK_US = 7 * 24 * HOUR_US
SUNDAY_US = 3 * 24 * HOUR_US


def _next_tick(x: str, step: int, origin: int = 0) -> str:
    return f"({x} - ((({x} - {origin}) % {step}) + {step}) % {step} + {step})"


def bridge_b(density: int = 20) -> str:
    """CTEs: pos_b, wm_b (positions and watermarks of Bridge B)."""
    return f"""
b_p AS (SELECT CAST(ceil(count(DISTINCT user_id) / {density}.0) AS BIGINT) AS p FROM events),
b_ev AS (
  SELECT event_type AS group_id, CAST(user_id % (SELECT p FROM b_p) AS INTEGER) AS "partition",
         ts, event_id, {_next_tick('epoch_us(ts)', HOUR_US)} AS tick_us
  FROM events),
b_rank AS (SELECT *, row_number() OVER (PARTITION BY "partition", tick_us ORDER BY ts, event_id) AS r FROM b_ev),
b_pg AS (SELECT "partition", tick_us, group_id, max(r) AS m FROM b_rank GROUP BY "partition", tick_us, group_id),
b_pp AS (SELECT "partition", tick_us, count(*) AS cnt FROM b_ev GROUP BY "partition", tick_us),
b_ticks AS (SELECT unnest(range(min(tick_us), max(tick_us) + 1, {HOUR_US})) AS tick_us FROM b_ev),
b_hwm AS (
  SELECT p."partition", t.tick_us, coalesce(c.cnt, 0) AS cnt,
         CAST(sum(coalesce(c.cnt, 0)) OVER (PARTITION BY p."partition" ORDER BY t.tick_us
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS high_watermark
  FROM (SELECT DISTINCT "partition" FROM b_ev) p CROSS JOIN b_ticks t
  LEFT JOIN b_pp c ON c."partition" = p."partition" AND c.tick_us = t.tick_us),
b_sparse AS (
  SELECT g.group_id, g."partition", g.tick_us, h.high_watermark - h.cnt + g.m AS c
  FROM b_pg g JOIN b_hwm h ON h."partition" = g."partition" AND h.tick_us = g.tick_us),
pos_b AS (
  SELECT 'events' AS cluster, k.group_id, 'events' AS topic, k."partition", t.tick_us AS ts_us,
         CAST(max(s.c) OVER (PARTITION BY k.group_id, k."partition" ORDER BY t.tick_us
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS committed_offset
  FROM (SELECT DISTINCT group_id, "partition" FROM b_ev) k CROSS JOIN b_ticks t
  LEFT JOIN b_sparse s ON s.group_id = k.group_id AND s."partition" = k."partition" AND s.tick_us = t.tick_us),
wm_b AS (SELECT 'events' AS cluster, 'events' AS topic, "partition", tick_us AS ts_us, high_watermark FROM b_hwm),
samples_b AS (
  SELECT p.cluster, p.group_id, p.topic, p."partition", p.ts_us, p.committed_offset, w.high_watermark,
         CASE WHEN w.high_watermark IS NOT NULL AND p.committed_offset IS NOT NULL
              THEN greatest(w.high_watermark - p.committed_offset, 0) END AS lag
  FROM pos_b p LEFT JOIN wm_b w
    ON w.cluster = p.cluster AND w.topic = p.topic AND w."partition" = p."partition" AND w.ts_us = p.ts_us)"""


def bridge_a() -> str:
    """CTE: samples_a (Bridge A samples)."""
    return f"""
a_lines AS (
  SELECT c.c_mktsegment AS group_id, o.o_orderpriority AS topic, CAST(l.l_linenumber - 1 AS INTEGER) AS "partition",
         {_next_tick('epoch_us(o.o_orderdate)', WEEK_US, SUNDAY_US)} AS prod_tick,
         {_next_tick('epoch_us(l.l_shipdate)', WEEK_US, SUNDAY_US)} AS cons_tick
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
a_prod AS (SELECT group_id, topic, "partition", prod_tick AS tick_us, count(*) AS p FROM a_lines GROUP BY ALL),
a_cons AS (SELECT group_id, topic, "partition", cons_tick AS tick_us, count(*) AS c FROM a_lines GROUP BY ALL),
a_ticks AS (SELECT unnest(range(least(min(prod_tick), min(cons_tick)),
                               greatest(max(prod_tick), max(cons_tick)) + 1, {WEEK_US})) AS tick_us FROM a_lines),
a_keys AS (SELECT group_id, topic, "partition" FROM a_prod UNION SELECT group_id, topic, "partition" FROM a_cons),
a_dense AS (
  SELECT k.group_id, k.topic, k."partition", t.tick_us,
         CAST(sum(coalesce(c.c, 0)) OVER w AS BIGINT) AS committed_offset,
         CAST(sum(coalesce(p.p, 0)) OVER w AS BIGINT) AS high_watermark
  FROM a_keys k CROSS JOIN a_ticks t
  LEFT JOIN a_prod p ON p.group_id = k.group_id AND p.topic = k.topic AND p."partition" = k."partition" AND p.tick_us = t.tick_us
  LEFT JOIN a_cons c ON c.group_id = k.group_id AND c.topic = k.topic AND c."partition" = k."partition" AND c.tick_us = t.tick_us
  WINDOW w AS (PARTITION BY k.group_id, k.topic, k."partition" ORDER BY t.tick_us
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
samples_a AS (
  SELECT 'orders' AS cluster, group_id, topic, "partition", tick_us AS ts_us, committed_offset, high_watermark,
         greatest(high_watermark - committed_offset, 0) AS lag
  FROM a_dense)"""


def evaluate(src: str, th: Thresholds, out: str, order: str = "ts_us", more: str = "") -> str:
    """CTE `out`: evaluated rows of samples CTE `src` (W1-W10, P2, P3), with
    columns `more` of it."""
    n = th.window_size
    r = min(5, n)
    pk = f"PARTITION BY {KEYC}, kind ORDER BY {order}"
    return f"""
{out}_k AS (
  SELECT *, CASE WHEN high_watermark IS NULL THEN 'unreadable'
                 WHEN committed_offset IS NULL THEN 'no_commit' ELSE 'window' END AS kind
  FROM {src}),
{out}_w1 AS (
  SELECT *,
    count(*) OVER w AS n, first_value(committed_offset) OVER w AS f_off, first_value(ts_us) OVER w AS f_ts,
    first_value(lag) OVER w AS f_lag,
    min(committed_offset) OVER wr AS r_min, max(committed_offset) OVER wr AS r_max,
    list(lag) OVER w AS lags,
    lag(lag, 1) OVER wk AS prev_lag,
    CASE WHEN committed_offset <> lag(committed_offset, 1) OVER wk THEN ts_us END AS chg
  FROM {out}_k
  WINDOW wk AS ({pk}), w AS ({pk} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW),
         wr AS ({pk} ROWS BETWEEN {r - 1} PRECEDING AND CURRENT ROW)),
{out}_w2 AS (
  SELECT *, max(chg) OVER ({pk} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS run,
         (ts_us - f_ts) / 1000000.0::DOUBLE AS dt, greatest(n // 3, 1) AS third
  FROM {out}_w1),
{out}_w3 AS (
  SELECT *,
    CASE WHEN n < 2 OR committed_offset = f_off OR dt = 0 THEN 0.0::DOUBLE
         ELSE (committed_offset - f_off) / dt END AS rate,
    CASE WHEN n < 2 OR dt = 0 THEN 0.0::DOUBLE ELSE (lag - f_lag) / dt END AS lrate,
    (n >= 2 AND r_min <> r_max) AS active,
    CASE WHEN n < 2 THEN 0.0::DOUBLE
         ELSE (ts_us - greatest(coalesce(run, f_ts), f_ts)) / 1000000.0::DOUBLE END AS idle,
    list_sum(list_slice(lags, 1, third)) / third AS ta,
    list_sum(list_slice(lags, n - third + 1, n)) / third AS tb
  FROM {out}_w2),
{out}_w4 AS (
  SELECT *,
    CASE WHEN n < 3 THEN 'UNKNOWN'
         WHEN ta = 0 AND tb = 0 THEN 'STABLE'
         WHEN ta <= 0 THEN CASE WHEN tb > 0 THEN 'INCREASING' ELSE 'STABLE' END
         WHEN abs((tb - ta) / ta) < {th.trend_threshold!r} THEN 'STABLE'
         WHEN (tb - ta) / ta > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS trend,
    CASE WHEN NOT active THEN
           CASE WHEN lag = 0 THEN 'EMPTY' WHEN idle > {th.inactivity_s!r} THEN 'STOPPED' ELSE 'STALLED' END
         WHEN rate < {th.stalled_rate!r} THEN 'STALLED'
         WHEN lag = 0 THEN 'EMPTY'
         WHEN lrate > {th.rapid_rate!r} THEN 'LAGGING'
         ELSE 'ACTIVE' END AS st
  FROM {out}_w3),
{out}_w5 AS (
  SELECT *,
    CASE WHEN st IN ('STOPPED', 'STALLED') THEN 'CRITICAL'
         WHEN st = 'LAGGING' THEN CASE WHEN trend = 'INCREASING' AND lrate > {th.rapid_rate!r}
                                       THEN 'CRITICAL' ELSE 'WARNING' END
         WHEN st IN ('EMPTY', 'ACTIVE') THEN CASE WHEN trend = 'INCREASING' AND lag > {th.lag_floor}
                                                  THEN 'WARNING' ELSE 'GOOD' END
         ELSE 'WARNING' END AS hl,
    (kind = 'window' AND n >= {th.min_size}) AS ok, (kind = 'window' AND n < {th.min_size}) AS insuf,
    kind = 'no_commit' AS nc
  FROM {out}_w4),
{out} AS (
  SELECT cluster, group_id, topic, "partition", ts_us, kind,
    CAST(CASE WHEN kind = 'window' THEN committed_offset WHEN nc THEN 0 END AS BIGINT) AS current_offset,
    high_watermark,
    CAST(CASE WHEN kind = 'window' THEN lag WHEN nc THEN 0 END AS BIGINT) AS current_lag,
    CAST(CASE WHEN kind = 'window' THEN n WHEN nc THEN 0 END AS INTEGER) AS n_records,
    CAST(CASE WHEN kind = 'window' THEN n / {n} * 100 WHEN nc THEN 0.0 END AS DOUBLE) AS window_completeness,
    CASE WHEN ok THEN rate WHEN kind = 'window' OR nc THEN 0.0 END AS consumption_rate,
    CASE WHEN ok THEN lrate WHEN kind = 'window' OR nc THEN 0.0 END AS lag_change_rate,
    CASE WHEN ok THEN active WHEN kind = 'window' OR nc THEN false END AS is_active,
    CASE WHEN ok THEN idle WHEN kind = 'window' OR nc THEN 0.0 END AS time_since_last_move_s,
    CASE WHEN ok THEN trend WHEN insuf THEN 'UNKNOWN' WHEN nc THEN '' END AS lag_trend,
    CASE WHEN ok THEN st WHEN kind = 'window' OR nc THEN 'UNKNOWN' END AS status,
    CASE WHEN ok THEN hl WHEN kind = 'window' OR nc THEN 'WARNING' END AS health,
    CAST(CASE WHEN kind = 'window' THEN prev_lag END AS BIGINT) AS prev_lag{more}
  FROM {out}_w5)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


STATUS_OUT = ("cluster, group_id, topic, \"partition\", ts_us, kind, current_offset, high_watermark, "
              "current_lag, n_records, window_completeness, consumption_rate, lag_change_rate, is_active, "
              "time_since_last_move_s, lag_trend, status, health, prev_lag")


def detect(src: str, th: Thresholds, out: str, tie: str = "0") -> str:
    """CTE `out`: gated event candidates (E1-E5) of evaluated CTE `src`, as a
    list_reduce fold per key over its rows in time order, then by `tie`."""
    gate_us = int(round(th.gate_s * 1_000_000))
    fl = th.lag_floor
    trans = ("CASE WHEN acc.p IS NULL OR acc.p = x.s THEN NULL "
             "WHEN x.s = 'STOPPED' AND acc.p IN ('ACTIVE', 'LAGGING') THEN 'consumer_stopped' "
             "WHEN x.s = 'STALLED' AND acc.p = 'ACTIVE' THEN 'consumer_stalled' "
             "WHEN x.s IN ('ACTIVE', 'EMPTY') AND acc.p IN ('STOPPED', 'STALLED') THEN 'consumer_recovered' END")
    fired = (f"list_filter([{{'ts': x.ts, 'i': x.i, 't': {trans}}}, "
             "{'ts': x.ts, 'i': x.i, 't': CASE WHEN x.e4 THEN 'rapid_lag_increase' END}, "
             "{'ts': x.ts, 'i': x.i, 't': CASE WHEN x.e5 THEN 'lag_cleared' END}], lambda z: z.t IS NOT NULL)")
    return f"""
{out}_c AS (
  SELECT cluster, group_id, topic, "partition", ts_us, CAST({tie} AS INTEGER) AS tie, status,
         (lag_change_rate > {th.rapid_rate!r} * 2 AND current_lag > {fl}) AS e4,
         (current_lag = 0 AND n_records > 2 AND coalesce(prev_lag > {fl}, false)) AS e5
  FROM {src} WHERE kind = 'window'),
{out}_f AS (
  SELECT cluster, group_id, topic, "partition",
    list_reduce(
      list({{'ts': ts_us, 'i': tie, 's': status, 'e4': e4, 'e5': e5}} ORDER BY ts_us, tie),
      lambda acc, x: CASE
        WHEN acc.e IS NOT NULL AND x.ts - acc.e < {gate_us} THEN acc
        ELSE {{'p': x.s,
              'e': CASE WHEN ({trans}) IS NOT NULL OR x.e4 THEN x.ts ELSE acc.e END,
              'ev': list_concat(acc.ev, {fired})}} END,
      {{'p': NULL::VARCHAR, 'e': NULL::BIGINT, 'ev': []::STRUCT(ts BIGINT, i INTEGER, t VARCHAR)[]}}) AS st
  FROM {out}_c GROUP BY cluster, group_id, topic, "partition"),
{out} AS (
  SELECT cluster, group_id, topic, "partition", z.ts AS ts_us, z.i AS tie, z.t AS event_type,
         CASE z.t WHEN 'consumer_stopped' THEN 'critical' WHEN 'consumer_stalled' THEN 'warning'
                  WHEN 'rapid_lag_increase' THEN 'warning' ELSE 'info' END AS severity
  FROM (SELECT cluster, group_id, topic, "partition", unnest(st.ev) AS z FROM {out}_f))"""


def attempts(src: str, th: Thresholds, out: str) -> str:
    """CTE `out`: every attempt to publish and its outcome.  The fold's state
    also holds, per event type, the last bucket that was remembered (b1..b5);
    publishing fails at offsets divisible by 3, the lookup at those by 4."""
    from tidewater.schemas import YEAR_ONE_OFFSET_S
    gate_us, fl, w = int(round(th.gate_s * 1_000_000)), th.lag_floor, int(th.dedup_s)
    trans = ("CASE WHEN acc.p IS NULL OR acc.p = x.s THEN 0 WHEN x.s = 'STOPPED' AND acc.p IN ('ACTIVE', 'LAGGING') THEN 1 "
             "WHEN x.s = 'STALLED' AND acc.p = 'ACTIVE' THEN 2 "
             "WHEN x.s IN ('ACTIVE', 'EMPTY') AND acc.p IN ('STOPPED', 'STALLED') THEN 3 ELSE 0 END")
    fires = {1: f"({trans}) = 1", 2: f"({trans}) = 2", 3: f"({trans}) = 3", 4: "x.e4", 5: "x.e5"}
    outcome = {c: f"CASE WHEN NOT x.lf AND acc.b{c} IS NOT DISTINCT FROM x.k THEN 'deduplicated' WHEN x.pf THEN 'failed' ELSE 'published' END"
               for c in fires}
    known = ", ".join(f"'b{c}': CASE WHEN {fires[c]} AND NOT x.lf THEN x.k ELSE acc.b{c} END" for c in fires)
    gated = " OR ".join(f"({fires[c]} AND ({outcome[c]}) <> 'failed')" for c in (1, 2, 3, 4))
    made = ", ".join(f"{{'ts': x.ts, 'c': CASE WHEN {fires[c]} THEN {c} END, 'o': {outcome[c]}}}" for c in fires)
    return f"""
{out}_c AS (
  SELECT cluster, group_id, topic, "partition", ts_us, status, current_offset % 3 = 0 AS pf, current_offset % 4 = 0 AS lf,
         (ts_us // 1000000 + {YEAR_ONE_OFFSET_S}) // {w} AS k,
         (lag_change_rate > {th.rapid_rate!r} * 2 AND current_lag > {fl}) AS e4,
         (current_lag = 0 AND n_records > 2 AND coalesce(prev_lag > {fl}, false)) AS e5
  FROM {src} WHERE kind = 'window'),
{out}_f AS (
  SELECT cluster, group_id, topic, "partition",
    list_reduce(
      list({{'ts': ts_us, 's': status, 'e4': e4, 'e5': e5, 'pf': pf, 'lf': lf, 'k': k}} ORDER BY ts_us),
      lambda acc, x: CASE
        WHEN acc.e IS NOT NULL AND x.ts - acc.e < {gate_us} THEN acc
        ELSE {{'p': x.s, 'e': CASE WHEN {gated} THEN x.ts ELSE acc.e END, {known},
              'ev': list_concat(acc.ev, list_filter([{made}], lambda z: z.c IS NOT NULL))}} END,
      {{'p': NULL::VARCHAR, 'e': NULL::BIGINT, {", ".join(f"'b{c}': NULL::BIGINT" for c in fires)},
        'ev': []::STRUCT(ts BIGINT, c INTEGER, o VARCHAR)[]}}) AS st
  FROM {out}_c GROUP BY cluster, group_id, topic, "partition"),
{out} AS (
  SELECT cluster, group_id, topic, "partition", z.ts AS ts_us, z.c AS ev, z.o AS outcome,
         ['consumer_stopped', 'consumer_stalled', 'consumer_recovered', 'rapid_lag_increase', 'lag_cleared'][z.c] AS event_type,
         ['critical', 'warning', 'info', 'warning', 'info'][z.c] AS severity
  FROM (SELECT cluster, group_id, topic, "partition", unnest(st.ev) AS z FROM {out}_f))"""
