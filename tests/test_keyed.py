"""Keyed streaming state: what it writes, when it ends, and where it starts."""

import datetime as dt

import pytest

from tidewater.config import Thresholds
from tidewater.operators.evaluate import evaluate
from tidewater.operators.incidents import detect, event_records
from tidewater.sources.positions import samples_from
from tidewater.streaming.keyed import REMOVED, KeyedMonitor, fresh_enough
from tidewater.streaming.monitor import SAMPLE_SCHEMA

T0 = dt.datetime(2024, 1, 1)
TH = Thresholds(window_size=4, min_size=2, stalled_rate=0.01, rapid_rate=5.0, inactivity_s=30.0, lag_floor=3, gate_s=20.0, dedup_s=20.0)
COLS = ["partition", "ts_us", "status", "n_records", "lag_trend", "health", "consumption_rate", "time_since_last_move_s"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def rows(secs, p=0, stuck=()):
    off, out = 0, []
    for s in secs:
        off = off if s in stuck else (s * 3) // 2
        out.append(("c", "g", "t", p, T0 + dt.timedelta(seconds=10 * s), off, s * 2 + 1))
    return out


def arrive(spark, mon, folder, n, part, schema=SAMPLE_SCHEMA, gate=True):
    spark.createDataFrame(part, schema).write.parquet(f"{folder}/arrival={n}")
    mon.run_windows(spark.readStream.schema(schema).parquet(f"{folder}/*/"))
    if gate:
        mon.run_gate()


def batch(spark, part):
    ev = evaluate(samples_from(spark.createDataFrame(part, SAMPLE_SCHEMA)), TH)
    return ev, event_records(ev, detect(ev, TH), TH)


def table(df, cols=COLS):
    return sorted(map(tuple, df.select(*cols).collect()))


EVENT = ["id", "ts_us", "type", "partition", "current_lag", "description"]


def test_stream_equals_batch_and_state_follows_touched_keys(spark, tmp_path):
    mon = KeyedMonitor(spark, TH, f"{tmp_path}/out")
    stuck = range(5, 13)
    first = [r for p in range(6) for r in rows(range(10), p, stuck)]
    second = rows(range(10, 20), 2, stuck)
    again = rows([3, 19], 2, stuck) + rows(range(20, 22), 2)
    for n, part in enumerate((first, second, again)):
        arrive(spark, mon, f"{tmp_path}/in", n, part)
    every = first + second + rows(range(20, 22), 2)
    ev, events = batch(spark, every)
    assert table(mon.status()) == table(ev)
    assert table(mon.events(), EVENT) == table(events, EVENT) != []
    assert [r.ts_us for r in mon.late().orderBy("ts_us").collect()] == [int((T0 + dt.timedelta(seconds=10 * s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for s in (3, 19)]
    written = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for name, p in mon.progress if name == "gate" and p["numInputRows"]]
    assert written == [6, 1, 1]                                     # one state row per touched key


def test_silence_removal_and_timers(spark, tmp_path):
    schema = SAMPLE_SCHEMA + ", kind string"
    mon = KeyedMonitor(spark, TH, f"{tmp_path}/out", ttl_s=100.0, watermark_s=10.0)
    def with_kind(part, kind=None):
        return [(*r, kind) for r in part]
    a = rows(range(0, 6)) + rows(range(0, 6), 1)
    b = rows(range(30, 36)) + rows([30], 1)                         # after 240 silent seconds
    arrive(spark, mon, f"{tmp_path}/in", 0, with_kind(a), schema, gate=False)
    arrive(spark, mon, f"{tmp_path}/in", 1, with_kind(b), schema, gate=True)
    arrive(spark, mon, f"{tmp_path}/in", 2, with_kind(rows([36]), REMOVED) + with_kind(rows([37, 38])), schema, gate=False)
    parts = [rows(range(0, 6)) + rows(range(0, 6), 1), b, rows([37, 38])]
    assert table(mon.status()) == sorted(x for part in parts for x in table(batch(spark, part)[0]))
    arrive(spark, mon, f"{tmp_path}/in", 3, with_kind(rows([90])), schema)
    arrive(spark, mon, f"{tmp_path}/in", 4, with_kind(rows([91])), schema)
    kept = [p["stateOperators"][0]["numRowsTotal"] for name, p in mon.progress if name == "gate"]
    assert max(kept) == 2 and kept[-1] == 1                         # the timer has freed partition 1


def test_restart_from_saved_state(spark, tmp_path):
    stuck = range(5, 13)
    first, last = [r for p in range(2) for r in rows(range(9), p, stuck)], [r for p in range(2) for r in rows(range(9, 20), p, stuck)]
    one = KeyedMonitor(spark, TH, f"{tmp_path}/one")
    arrive(spark, one, f"{tmp_path}/in1", 0, first)
    windows, gates = one.saved_windows(), one.saved_gates()
    newest = windows.agg({"seen_us": "max"}).head()[0]
    two = KeyedMonitor(spark, TH, f"{tmp_path}/two", windows=fresh_enough(windows, newest, 60), gates=fresh_enough(gates, newest, 60))
    arrive(spark, two, f"{tmp_path}/in2", 0, last)
    ev, events = batch(spark, first + last)
    assert table(one.status().unionByName(two.status())) == table(ev)
    assert table(one.events().unionByName(two.events()), EVENT) == table(events, EVENT)
    stale = fresh_enough(windows, newest + 61_000_000, 60)          # too old: a cold start
    assert stale.count() == 0
    cold = KeyedMonitor(spark, TH, f"{tmp_path}/cold", windows=stale)
    arrive(spark, cold, f"{tmp_path}/in3", 0, last, gate=False)
    assert table(cold.status()) == table(batch(spark, last)[0])
    broken = windows.selectExpr("cluster", "group_id", "topic", "partition", "cast(null as bigint) seen_us", "session_us", "records")
    with pytest.raises(Exception, match="saved state without seen_us"):
        fresh_enough(broken, newest, 60).collect()
