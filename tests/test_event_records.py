"""Message text (W11), JSON round trip (X11, S5/C1), disabled publisher (E8),
event ids (X7), error counts and last durations (A8, A10)."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.config import Thresholds
from tidewater.operators import consume as CS
from tidewater.operators import rollup as R
from tidewater.operators.evaluate import evaluate
from tidewater.operators.incidents import detect, event_records, incidents
from tidewater.sources import event_io as EIO
from tidewater.sources.positions import samples_from

T0 = dt.datetime(2024, 1, 1)
COLS = ("cluster string, group_id string, topic string, partition int, ts timestamp_ntz, "
        "committed_offset bigint, high_watermark bigint")


def _ev(spark, rows, th):
    df = spark.createDataFrame([("c", "g", "t", p, T0 + dt.timedelta(seconds=s), o, h) for p, s, o, h in rows], COLS)
    return evaluate(samples_from(df), th)


def _msg(ev, p):
    return ev.filter(F.col("partition") == p).orderBy(F.col("ts_us").desc()).first().message


def test_status_messages(spark):
    th = Thresholds(window_size=5, min_size=2, stalled_rate=0.5, rapid_rate=1.0, inactivity_s=25.0)
    rows = []
    rows += [(0, s, 10, 10) for s in (0, 10)]                    # idle, caught up
    rows += [(1, s, 10, 50) for s in (0, 10, 20, 30)]            # idle 30s > 25s with lag
    rows += [(2, s, 10, 50) for s in (0, 10)]                    # idle 10s with lag
    rows += [(3, 0, 10, 100), (3, 10, 12, 100)]                  # slow: 0.2 msg/s
    rows += [(4, 0, 10, 10), (4, 10, 40, 40)]                    # moving, caught up
    rows += [(5, 0, 10, 20), (5, 10, 40, 100)]                   # lag +5/s
    rows += [(6, 0, 10, 20), (6, 10, 40, 50)]                    # 3 msg/s, lag 10
    rows += [(7, 0, 10, 20)]                                     # insufficient
    ev = _ev(spark, rows, th)
    assert _msg(ev, 0) == "Consumer is caught up and idle"
    assert _msg(ev, 1) == "Consumer stopped for 30s with lag 40"
    assert _msg(ev, 2) == "Consumer stalled for 10s"
    assert _msg(ev, 3) == "Very slow consumption: 0.20 msg/s"
    assert _msg(ev, 4) == "Consumer is actively processing and caught up"
    assert _msg(ev, 5) == "Lag increasing rapidly at 5.00 msg/s"
    assert _msg(ev, 6) == "Processing at 3.00 msg/s with lag 10"
    assert _msg(ev, 7) == "Insufficient data: 1/2 records"


def _records(spark):
    th = Thresholds(window_size=5, min_size=2, stalled_rate=0.5, rapid_rate=1.0, inactivity_s=25.0,
                    lag_floor=5, gate_s=5.0, dedup_s=300.0)
    rows = [(0, s, 10 + 3 * s, 20 + 3 * s) for s in range(0, 30, 10)] + [(0, s, 100, 200) for s in range(30, 80, 10)]
    return th, _ev(spark, rows, th)


def test_json_round_trip_and_disabled(spark):
    th, ev = _records(spark)
    rec = event_records(ev, detect(ev, th), th)
    n = rec.count()
    assert n > 0
    env = EIO.envelope(rec)
    back = CS.accepted(CS.parse(env))
    cols = ["id", "type", "severity", "fingerprint", "consumer_group", "partition", "current_lag", "description",
            "time_since_last_move"]
    assert sorted(tuple(r) for r in back.select(*cols).collect()) == \
        sorted(tuple(r) for r in rec.select(*cols).collect())
    assert incidents(ev, th, enabled=False).count() == 0


def test_random_ids_when_requested(spark):
    th, ev = _records(spark)
    rec = event_records(ev, detect(ev, th), th, deterministic_ids=False).select("id", "fingerprint").collect()
    assert all(len(r.id) == 36 and r.id != r.fingerprint for r in rec)


def test_error_counts_and_last_duration(spark):
    rej = spark.createDataFrame([("a", "g1", 1), ("a", "g2", 1), ("b", "g1", 2)], "cluster string, group_id string, ts_us long")
    assert sorted(tuple(r) for r in R.error_count_per_cluster(rej).collect()) == [("a", 2), ("b", 1)]
    d = spark.createDataFrame([("a", "g", 1, 0.5), ("a", "g", 2, 0.25)], "cluster string, group_id string, ts_us long, duration_s double")
    assert R.last_cycle_duration(d).first().duration_s == 0.25
    h = {r.le: r.n for r in R.duration_histogram(d).collect()}
    assert h["0.25"] == 1 and h["0.5"] == 2 and h["+Inf"] == 2
