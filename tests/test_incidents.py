"""Gate fold (E1-E5), records and dedup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from model import fold_events
from tidewater.config import Thresholds
from tidewater.operators.incidents import dedup, detect, detect_with_state, event_records

TH = Thresholds(window_size=5, min_size=2, rapid_rate=1.0, lag_floor=1000, gate_s=300.0, dedup_s=300.0)
COLS = ("cluster string, group_id string, topic string, partition int, ts_us long, kind string, "
        "status string, lag_change_rate double, current_lag long, n_records int, prev_lag long")


def _ev(spark, rows):
    """rows: (partition, sec, status, lrate, lag, n, prev_lag)."""
    return spark.createDataFrame([("c", "g", "t", p, s * 1_000_000, "window", st, float(lr), lag, n, pl)
                                  for p, s, st, lr, lag, n, pl in rows], COLS)


def _types(df):
    return [(r.ts_us // 1_000_000, r.event_type) for r in df.orderBy("ts_us", "ev").collect()]


def test_transitions_without_events(spark):
    # LAGGING->STALLED, STALLED->UNKNOWN, UNKNOWN->ACTIVE, ACTIVE->EMPTY, EMPTY->STOPPED
    rows = [(0, 0, "LAGGING", 0, 5, 5, 5), (0, 400, "STALLED", 0, 5, 5, 5),
            (0, 800, "UNKNOWN", 0, 5, 5, 5), (0, 1200, "ACTIVE", 0, 5, 5, 5),
            (0, 1600, "EMPTY", 0, 0, 5, 5), (0, 2000, "STOPPED", 0, 5, 5, 0)]
    assert _types(detect(_ev(spark, rows), TH)) == []


def test_stopped_to_empty_recovers_and_gate_freezes(spark):
    rows = [(0, 0, "STOPPED", 0, 5, 5, 5), (0, 10, "EMPTY", 0, 0, 5, 5),   # recovered at 10
            (0, 100, "STALLED", 0, 5, 5, 0), (0, 200, "ACTIVE", 0, 5, 5, 5),  # gated
            (0, 310, "ACTIVE", 0, 5, 5, 5)]  # compares with frozen EMPTY: no event
    assert _types(detect(_ev(spark, rows), TH)) == [(10, "consumer_recovered")]
    rows2 = rows[:2] + [(0, 100, "ACTIVE", 0, 5, 5, 0), (0, 310, "STALLED", 0, 5, 5, 5)]
    # at 310 (>= 300 after 10) previous is the frozen EMPTY -> STALLED from EMPTY: none
    assert _types(detect(_ev(spark, rows2), TH)) == [(10, "consumer_recovered")]


def test_rapid_threshold_is_strict_and_cleared_does_not_gate(spark):
    rows = [(0, 0, "ACTIVE", 2.0, 5000, 5, 10), (0, 10, "ACTIVE", 2.0001, 5000, 5, 5000),
            (0, 400, "ACTIVE", 0.0, 0, 5, 5000), (0, 410, "ACTIVE", 0.0, 0, 5, 2000)]
    # exactly 2x rapid_rate: no event; above: event + gate until 310; cleared
    # after the gate fires twice because it does not set the gate itself
    assert _types(detect(_ev(spark, rows), TH)) == [(10, "rapid_lag_increase"), (400, "lag_cleared"),
                                                    (410, "lag_cleared")]
    rows = [(0, 0, "ACTIVE", 0.0, 0, 5, 5000), (0, 10, "ACTIVE", 0.0, 0, 5, 2000)]
    assert _types(detect(_ev(spark, rows), TH)) == [(0, "lag_cleared"), (10, "lag_cleared")]


def test_cleared_twice_in_one_bucket_dedups_to_one(spark):
    rows = [(0, 0, "ACTIVE", 0.0, 0, 5, 5000), (0, 10, "ACTIVE", 0.0, 0, 5, 2000)]
    ev = _ev(spark, rows).withColumn("current_offset", F.lit(1).cast("long")) \
        .withColumn("high_watermark", F.lit(1).cast("long")).withColumn("consumption_rate", F.lit(0.0)) \
        .withColumn("time_since_last_move_s", F.lit(90.5)).withColumn("window_completeness", F.lit(100.0)) \
        .withColumn("health", F.lit("GOOD")).withColumn("lag_trend", F.lit("STABLE")) \
        .withColumn("is_active", F.lit(True)).withColumn("message", F.lit("m"))
    rec = event_records(ev, detect(ev, TH), TH)
    assert rec.count() == 2
    out = dedup(rec).collect()
    assert len(out) == 1 and out[0].ts_us == 0 and out[0].time_since_last_move == "1m30.5s"
    assert out[0].title == "Kafka Consumer lag_cleared: g"


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_differential_across_small_batches(spark, seed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(seed)
        sts = ["ACTIVE", "LAGGING", "STALLED", "STOPPED", "EMPTY", "UNKNOWN"]
        rows, per = [], {}
        for p in range(5):
            t, prev_lag = 0, None
            for i in range(80):
                t += int(rng.choice([60, 120, 180]))
                lag = int(rng.choice([0, 0, 500, 1500]))
                row = (p, t, str(rng.choice(sts, p=[.35, .1, .2, .15, .15, .05])), float(rng.choice([0, 1.5, 3.0])),
                       lag, int(min(i + 1, 5)), prev_lag)
                rows.append(row)
                per.setdefault(p, []).append((t * 1_000_000, row[2], row[3], lag, row[5], prev_lag))
                prev_lag = lag
        got = detect(_ev(spark, rows), TH).collect()
        got_set = sorted((r.partition, r.ts_us, r.event_type) for r in got)
        want = sorted((p, ts, typ) for p, ser in per.items() for ts, typ in fold_events(ser, TH))
        assert got_set == want
        # streaming: fold the first half, carry the state, fold the rest
        df = _ev(spark, rows)
        cut = 80 * 120 // 2 * 1_000_000
        e1, st = detect_with_state(df.filter(F.col("ts_us") < cut), TH, None)
        e2, _ = detect_with_state(df.filter(F.col("ts_us") >= cut), TH, st)
        both = sorted((r.partition, r.ts_us, r.event_type) for r in e1.unionByName(e2).collect())
        assert both == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed,hot", [(3, 9), (4, 25), (5, 4)])
def test_hot_key_split_fold_is_exact(spark, seed, hot):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        rng = np.random.default_rng(seed)
        sts = ["ACTIVE", "LAGGING", "STALLED", "STOPPED", "EMPTY", "UNKNOWN"]
        rows, per = [], {}
        for p in range(3):
            t, prev_lag = 0, None
            for i in range(120):
                t += int(rng.choice([30, 60, 120, 400]))
                lag = int(rng.choice([0, 0, 500, 1500]))
                row = (p, t, str(rng.choice(sts, p=[.35, .1, .2, .15, .15, .05])), float(rng.choice([0, 1.5, 3.0])),
                       lag, 5, prev_lag)
                rows.append(row)
                per.setdefault(p, []).append((t * 1_000_000, row[2], row[3], lag, 5, prev_lag))
                prev_lag = lag
        got = sorted((r.partition, r.ts_us, r.event_type) for r in detect(_ev(spark, rows), TH, hot_key_rows=hot).collect())
        want = sorted((p, ts, typ) for p, ser in per.items() for ts, typ in fold_events(ser, TH))
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed,hot", [(6, 9), (7, 30), (8, 4)])
def test_split_fold_carries_state_between_batches(spark, seed, hot):
    """Three batches, each folded in segments from the state of the one before,
    with several rows at the same time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        rng = np.random.default_rng(seed)
        sts = ["ACTIVE", "LAGGING", "STALLED", "STOPPED", "EMPTY", "UNKNOWN"]
        rows, per = [], {}
        for p in range(3):
            t, prev_lag, tie = 0, None, 0
            for i in range(120 if p else 20):
                step = int(rng.choice([0, 30, 60, 120, 400]))
                t, tie = t + step, 0 if step else tie + 1
                lag = int(rng.choice([0, 0, 500, 1500]))
                row = (p, t, str(rng.choice(sts, p=[.35, .1, .2, .15, .15, .05])), float(rng.choice([0, 1.5, 3.0])),
                       lag, 5, prev_lag)
                rows.append((*row, tie if i else 0))
                per.setdefault(p, []).append((t * 1_000_000, row[2], row[3], lag, 5, prev_lag))
                prev_lag = lag
        df = _ev(spark, [r[:7] for r in rows])
        ties = spark.createDataFrame([(i, r[7]) for i, r in enumerate(rows)], "_i int, tie int")
        df = spark.createDataFrame([(*tuple(a), b[1]) for a, b in zip(df.collect(), ties.collect())],
                                   df.schema.add("tie", "integer"))
        state, got = None, []
        for lo, hi in ((0, 5000), (5000, 9000), (9000, 10**6)):
            part = df.filter((F.col("ts_us") >= lo * 1_000_000) & (F.col("ts_us") < hi * 1_000_000))
            events, new = detect_with_state(part, TH, state, hot_key_rows=hot)
            got += events.collect()
            touched = new.select("cluster", "group_id", "topic", "partition", "prev_st", "last_us").collect()
            keep = {tuple(r)[:4]: tuple(r) for r in (state.collect() if state is not None else [])}
            keep.update({tuple(r)[:4]: tuple(r) for r in touched})
            state = spark.createDataFrame(list(keep.values()), new.schema)
        want = sorted((p, ts, typ) for p, ser in per.items() for ts, typ in fold_events(ser, TH))
        assert sorted((r.partition, r.ts_us, r.event_type) for r in got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
