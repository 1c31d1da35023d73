"""Window evaluation: hand-made edge cases and a differential test against
the plain-Python model for several window sizes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from model import evaluate_series
from tidewater.config import TEST_SETTINGS, Thresholds
from tidewater.operators.evaluate import evaluate, partition_status
from tidewater.operators.rollup import group_status
from tidewater.sources.positions import join_watermarks, samples_from

T0 = dt.datetime(2024, 1, 1)
T0_US = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def _samples(spark, rows):
    """rows: (group, partition, sec, offset, hwm)."""
    data = [("c", g, "t", p, T0 + dt.timedelta(seconds=s), o, h) for g, p, s, o, h in rows]
    df = spark.createDataFrame(data, "cluster string, group_id string, topic string, partition int, "
                                     "ts timestamp_ntz, committed_offset bigint, high_watermark bigint")
    return samples_from(df)


def _last(ev):
    return ev.orderBy(F.col("ts_us").desc()).first()


def test_lags_and_shared_watermark(spark):
    pos = spark.createDataFrame(
        [("c", "g1", "t", 0, T0, 100), ("c", "g1", "t", 1, T0, 200), ("c", "g1", "t", 2, T0, 50),
         ("c", "g2", "t", 0, T0, 90), ("c", "g2", "t", 1, T0, None)],
        "cluster string, group_id string, topic string, partition int, ts timestamp_ntz, committed_offset bigint")
    wm = spark.createDataFrame([("c", "t", 0, T0, 150), ("c", "t", 1, T0, 250), ("c", "t", 2, T0, 100)],
                               "cluster string, topic string, partition int, ts timestamp_ntz, high_watermark bigint")
    s = join_watermarks(pos, wm)
    lags = {(r.group_id, r.partition): r.lag for r in s.collect()}
    assert lags == {("g1", 0): 50, ("g1", 1): 50, ("g1", 2): 50, ("g2", 0): 60, ("g2", 1): None}
    ev = evaluate(s, TEST_SETTINGS)
    nc = ev.filter("group_id = 'g2' and partition = 1").first()
    assert (nc.status, nc.health, nc.lag_trend, nc.message, nc.current_lag, nc.high_watermark) == \
        ("UNKNOWN", "WARNING", "", "No committed offset", 0, 250)


def test_missing_watermark_counts_in_partition_count(spark):
    pos = spark.createDataFrame([("c", "g", "t", 0, T0, 10), ("c", "g", "t", 1, T0, 10)],
                                "cluster string, group_id string, topic string, partition int, "
                                "ts timestamp_ntz, committed_offset bigint")
    wm = spark.createDataFrame([("c", "t", 0, T0, 20)],
                               "cluster string, topic string, partition int, ts timestamp_ntz, high_watermark bigint")
    ev = evaluate(join_watermarks(pos, wm), TEST_SETTINGS)
    assert partition_status(ev).count() == 1
    g = group_status(ev).first()
    assert g.partition_count == 2 and g.total_lag == 10


def test_offset_above_watermark_gives_zero_lag(spark):
    ev = evaluate(_samples(spark, [("g", 0, 0, 120, 100)]), TEST_SETTINGS)
    assert ev.first().current_lag == 0


def test_min_size_guard_and_trend_needs_three(spark):
    th = TEST_SETTINGS  # window 5, min 2
    ev = evaluate(_samples(spark, [("g", 0, 0, 10, 20), ("g", 0, 1, 12, 20), ("g", 0, 2, 14, 20)]), th)
    rows = ev.orderBy("ts_us").collect()
    assert rows[0].status == "UNKNOWN" and rows[0].message == "Insufficient data: 1/2 records"
    assert rows[1].status != "UNKNOWN" and rows[1].lag_trend == "UNKNOWN"
    assert rows[2].lag_trend != "UNKNOWN"


def test_activity_looks_at_last_five(spark):
    th = Thresholds(window_size=10, min_size=2, stalled_rate=0.0, rapid_rate=100.0, inactivity_s=1000.0)
    rows = [("g", 0, 0, 1, 50)] + [("g", 0, s, 2, 50) for s in range(1, 6)]
    ev = evaluate(_samples(spark, rows), th).orderBy("ts_us").collect()
    assert ev[4].is_active is True      # last five: 1,2,2,2,2
    assert ev[5].is_active is False     # last five: 2,2,2,2,2


def test_idle_equal_to_timeout_is_stalled(spark):
    th = Thresholds(window_size=10, min_size=2, stalled_rate=0.1, rapid_rate=1.0, inactivity_s=5.0)
    rows = [("g", 0, s, 7, 20) for s in range(0, 6)]
    ev = evaluate(_samples(spark, rows), th).orderBy("ts_us").collect()
    assert ev[5].time_since_last_move_s == 5.0 and ev[5].status == "STALLED"


def test_offset_reset_is_stalled(spark):
    th = Thresholds(window_size=5, min_size=2, stalled_rate=0.1)
    ev = evaluate(_samples(spark, [("g", 0, 0, 100, 200), ("g", 0, 1, 5, 200)]), th).orderBy("ts_us").collect()
    assert ev[1].consumption_rate < 0 and ev[1].status == "STALLED"


def test_equal_timestamps_rates_zero(spark):
    th = Thresholds(window_size=5, min_size=2)
    df = _samples(spark, [("g", 0, 0, 1, 10)]).unionByName(_samples(spark, [("g", 1, 0, 1, 10)]))
    ev = evaluate(df, th).collect()
    assert all(r.consumption_rate == 0 and r.lag_change_rate == 0 for r in ev)


def test_lag_floor_health(spark):
    th = Thresholds(window_size=3, min_size=3, stalled_rate=0.0, rapid_rate=1e9, trend_threshold=0.1,
                    inactivity_s=1e9, lag_floor=1000)
    for lag, health in ((1000, "GOOD"), (1001, "WARNING")):
        rows = [("g", 0, 0, 0, 10), ("g", 0, 1, 5, 400), ("g", 0, 2, 10, 10 + lag)]
        r = _last(evaluate(_samples(spark, rows), th))
        assert r.lag_trend == "INCREASING" and r.status == "ACTIVE" and r.health == health


def test_trend_first_third_zero_and_threshold(spark):
    th = Thresholds(window_size=3, min_size=3, stalled_rate=0.0, rapid_rate=1e9, trend_threshold=0.5,
                    inactivity_s=1e9)
    r = _last(evaluate(_samples(spark, [("g", 0, 0, 5, 5), ("g", 0, 1, 6, 8), ("g", 0, 2, 7, 9)]), th))
    assert r.lag_trend == "INCREASING"
    # lags 2 -> 3: relative change exactly 0.5 = threshold -> not STABLE
    r = _last(evaluate(_samples(spark, [("g", 0, 0, 5, 7), ("g", 0, 1, 6, 8), ("g", 0, 2, 7, 10)]), th))
    assert r.lag_trend == "INCREASING"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 20])
def test_differential_against_model(spark, n):
    rng = np.random.default_rng(n)
    th = Thresholds(window_size=n, min_size=max(2, n // 2), stalled_rate=0.05, rapid_rate=0.3,
                    trend_threshold=0.1, inactivity_s=25.0, lag_floor=8)
    rows, series = [], {}
    for p in range(6):
        off, end, t = 0, 0, 0
        for i in range(60):
            t += int(rng.choice([5, 10, 10, 20]))
            end += int(rng.integers(0, 4))
            if rng.random() < 0.6:
                off = min(end + int(rng.integers(-1, 2)), off + int(rng.integers(0, 5)))
            if rng.random() < 0.03:
                off = max(0, off - 7)  # offset reset
            rows.append(("g", p, t, off, end))
            series.setdefault(p, []).append((T0_US + t * 1_000_000, off, max(end - off, 0)))
    ev = evaluate(_samples(spark, rows), th).collect()
    got = {(r.partition, r.ts_us): r for r in ev}
    for p, ser in series.items():
        for (ts, _, _), m in zip(ser, evaluate_series(ser, th)):
            r = got[(p, ts)]
            assert (r.status, r.lag_trend, r.health, r.is_active) == (m["status"], m["trend"], m["health"], m["active"]), (p, ts)
            assert r.consumption_rate == pytest.approx(m["rate"]) and r.lag_change_rate == pytest.approx(m["lrate"])
            assert r.time_since_last_move_s == pytest.approx(m["idle"])


@pytest.mark.parametrize("n,hot", [(5, 7), (10, 13), (4, 3)])
def test_hot_key_split_equals_unsplit(spark, n, hot):
    rng = np.random.default_rng(100 + n)
    th = Thresholds(window_size=n, min_size=2, stalled_rate=0.05, rapid_rate=0.3, trend_threshold=0.1,
                    inactivity_s=25.0, lag_floor=8)
    rows = []
    for p in range(4):
        off, end, t = 0, 0, 0
        for i in range(40 if p < 3 else 5):
            # bursts and long gaps so some segments are empty or tiny
            t += int(rng.choice([1, 2, 3, 200])) if p != 1 else int(rng.choice([1, 500]))
            end += int(rng.integers(0, 4))
            if rng.random() < 0.6:
                off = min(end, off + int(rng.integers(0, 5)))
            hwm = None if rng.random() < 0.05 else end
            c = None if rng.random() < 0.05 else off
            rows.append(("g", p, t, c, hwm))
    df = _samples(spark, rows)
    cols = ["partition", "ts_us", "kind", "n_records", "status", "lag_trend", "health", "consumption_rate",
            "lag_change_rate", "time_since_last_move_s", "is_active", "prev_lag", "message"]
    a = sorted(tuple(r) for r in evaluate(df, th).select(*cols).collect())
    b = sorted(tuple(r) for r in evaluate(df, th, hot_key_rows=hot).select(*cols).collect())
    assert a == b


def test_per_cluster_thresholds_with_hot_split(spark):
    from tidewater.config import thresholds_frame
    rows = [(g, p, t, (t * 7) // 3 if t % 5 else t, t * 3) for g in ("a", "b") for p in range(2) for t in range(30)]
    df = _samples(spark, rows).withColumn(
        "cluster", F.when(F.col("group_id") == "a", F.lit("x")).otherwise(F.lit("y")))
    th = thresholds_frame(spark, {"x": Thresholds(window_size=4, min_size=2, stalled_rate=0.5),
                                  "y": Thresholds(window_size=7, min_size=3, rapid_rate=0.1)})
    cols = ["cluster", "partition", "ts_us", "n_records", "status", "lag_trend", "health", "consumption_rate"]
    a = sorted(tuple(r) for r in evaluate(df, th).select(*cols).collect())
    b = sorted(tuple(r) for r in evaluate(df, th, hot_key_rows=6).select(*cols).collect())
    assert a == b and {r[3] for r in a} == {1, 2, 3, 4, 5, 6, 7}


def test_all_clusters_in_one_window_pass(spark):
    """The plan for three window sizes has the windows of one, and the results
    are those of each cluster by itself."""
    from tidewater.config import thresholds_frame
    own = {"x": Thresholds(window_size=1, min_size=1), "y": Thresholds(window_size=3, min_size=2, rapid_rate=0.1),
           "z": Thresholds(window_size=9, min_size=3, stalled_rate=0.5)}
    rng = np.random.default_rng(5)
    rows = [("g", p, t, int(rng.integers(0, 3)) + t // 2, t * 3) for p in range(3) for t in range(25)]
    one = _samples(spark, rows).drop("cluster")
    df = one.withColumn("cluster", F.explode(F.array(*[F.lit(c) for c in own]))).select("cluster", *one.columns)
    ev = evaluate(df, thresholds_frame(spark, own))
    cols = [c for c in ev.columns if c != "cluster"]
    for c, th in own.items():
        alone = evaluate(df.filter(F.col("cluster") == c), th).select(*cols).collect()
        assert sorted(map(str, ev.filter(F.col("cluster") == c).select(*cols).collect())) == sorted(map(str, alone))

    def count(frame, word):
        return frame._jdf.queryExecution().optimizedPlan().toString().count(word)
    single = evaluate(df, own["z"])
    assert count(ev, "row_number()") == count(single, "row_number()") == 1


def test_rows_of_one_time_keep_their_order(spark):
    """`seq` decides among equal times, whatever the order of rows and however
    they are split; without it the values do."""
    rng = np.random.default_rng(8)
    rows = [("g", p, t // 3 * 10, int(rng.integers(0, 50)), 60) for p in range(2) for t in range(60)]
    s = _samples(spark, rows)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(s.collect())], s.schema.add("seq", "long"))
    th = Thresholds(window_size=7, min_size=2, stalled_rate=0.05, rapid_rate=0.3, inactivity_s=25.0, lag_floor=8)
    cols = ["partition", "ts_us", "tie", "current_offset", "n_records", "status", "lag_trend", "consumption_rate", "prev_lag"]

    def got(d, **kw):
        return sorted(tuple(r) for r in evaluate(d, th, **kw).select(*cols).collect())
    base = got(df)
    offsets = {}
    for r in rows:
        offsets.setdefault((r[1], r[2]), []).append(r[3])
    assert [r[3] for r in base] == [o for k in sorted(offsets) for o in offsets[k]] and {r[2] for r in base} == {0, 1, 2}
    assert got(df.orderBy(F.rand(1))) == base == got(df, hot_key_rows=9) == got(df.repartition(5), hot_key_rows=20)
    bare = got(df.drop("seq"))
    assert bare != base and bare == got(df.drop("seq").orderBy(F.desc("seq"))) == got(df.drop("seq"), hot_key_rows=9)


def test_arrival_from_files(spark, tmp_path):
    from tidewater.sources.positions import with_arrival
    rows = [("g", 0, 5, off, 60) for off in (9, 3, 7, 1)]
    for i in (0, 2):
        raw = _samples(spark, rows[i:i + 2])
        raw.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    df = with_arrival(spark.read.parquet(str(tmp_path / "in*")))
    ev = evaluate(df, Thresholds(window_size=3, min_size=1)).orderBy("tie").collect()
    assert [(r.tie, r.current_offset, r.n_records) for r in ev] == [(0, 9, 1), (1, 3, 2), (2, 7, 3), (3, 1, 3)]
