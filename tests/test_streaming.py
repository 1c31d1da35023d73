"""Streaming monitor (ST1, ST2, ST7) and streaming dedup (ST4)."""

import datetime as dt



from tidewater.config import Thresholds
from tidewater.operators.evaluate import evaluate
from tidewater.sources.positions import samples_from
from tidewater.streaming.monitor import StreamingMonitor, dedup_stream, run_available

T0 = dt.datetime(2024, 1, 1)
TH = Thresholds(window_size=4, min_size=2, stalled_rate=0.01, rapid_rate=5.0, inactivity_s=30.0, lag_floor=3,
                gate_s=20.0, dedup_s=20.0)
COLS = ("cluster string, group_id string, topic string, partition int, ts timestamp_ntz, "
        "committed_offset bigint, high_watermark bigint")


def _rows(secs, p=0):
    return [("c", "g", "t", p, T0 + dt.timedelta(seconds=10 * s), (s * 3) // 2 if s % 7 else s, s * 2 + 1)
            for s in secs]


def test_stream_equals_batch_and_late_rows(spark, tmp_path):
    root = str(tmp_path)
    mon = StreamingMonitor(spark, TH, f"{root}/out")
    first = _rows(range(0, 10)) + _rows(range(0, 10), 1)
    second = _rows([5]) + _rows(range(10, 20)) + _rows(range(10, 20), 1)
    spark.createDataFrame(first, COLS).write.parquet(f"{root}/in/s=0")
    run_available(spark, mon, f"{root}/in/*/")
    spark.createDataFrame(second, COLS).write.parquet(f"{root}/in/s=1")
    run_available(spark, mon, f"{root}/in/*/")
    assert mon.late().count() == 1
    batch = evaluate(samples_from(spark.createDataFrame(first + second[1:], COLS)), TH, messages=False)
    cols = ["partition", "ts_us", "status", "lag_trend", "health", "consumption_rate", "time_since_last_move_s"]
    got = sorted(tuple(r) for r in mon.status().select(*cols).collect())
    want = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert got == want


def test_dedup_stream(spark, tmp_path):
    ev = spark.createDataFrame([("a", 1_000_000), ("a", 2_000_000), ("b", 3_000_000), ("a", 4_000_000)],
                               "fingerprint string, ts_us long")
    ev.write.parquet(f"{tmp_path}/ev")
    src = spark.readStream.schema("fingerprint string, ts_us long").parquet(f"{tmp_path}/ev")
    q = (dedup_stream(src, 300).writeStream.format("memory").queryName("dedup_t")
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.sql("select fingerprint from dedup_t").collect()
    assert sorted(r.fingerprint for r in out) == ["a", "b"]


def test_state_ttl_drops_idle_keys(spark, tmp_path):
    root = str(tmp_path)
    mon = StreamingMonitor(spark, TH, f"{root}/out", publish=False, state_ttl_s=60.0)
    spark.createDataFrame(_rows(range(0, 5)) + _rows(range(0, 5), 1), COLS).write.parquet(f"{root}/in/s=0")
    run_available(spark, mon, f"{root}/in/*/")
    spark.createDataFrame(_rows(range(20, 25)), COLS).write.parquet(f"{root}/in/s=1")
    run_available(spark, mon, f"{root}/in/*/")
    tails = [v for v in mon._versions("tail")]
    last = spark.read.parquet(f"{root}/out/tail/v={tails[-1]}")
    assert {r.partition for r in last.select("partition").distinct().collect()} == {0}


def test_late_batch_keeps_state(spark, tmp_path):
    """A batch of late rows only, with a TTL set, must leave tail and gate as they are."""
    root = str(tmp_path)
    mon = StreamingMonitor(spark, TH, f"{root}/out", state_ttl_s=600.0)
    for i, part in enumerate((_rows(range(0, 8)) + _rows(range(0, 8), 1), _rows([2]), _rows(range(8, 14)))):
        spark.createDataFrame(part, COLS).write.parquet(f"{root}/in/s={i}")
        run_available(spark, mon, f"{root}/in/*/")
    tails, gates = mon._versions("tail"), mon._versions("gate")
    sizes = [spark.read.parquet(f"{root}/out/tail/v={v}").count() for v in tails]
    assert sizes == [6, 6, 6]
    assert [spark.read.parquet(f"{root}/out/gate/v={v}").count() for v in gates] == [2, 2, 2]
    batch = evaluate(samples_from(spark.createDataFrame(_rows(range(0, 14)) + _rows(range(0, 8), 1), COLS)), TH)
    cols = ["partition", "ts_us", "status", "n_records"]
    assert sorted(map(tuple, mon.status().select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_one_event_per_fingerprint_over_batches(spark, tmp_path):
    """Lag cleared twice in one bucket: one event, in one batch or in two."""
    from tidewater.operators.incidents import incidents
    th = TH.with_(gate_s=1.0, dedup_s=3600.0)
    lags = [9, 9, 9, 0, 9, 9, 9, 0, 9, 0]
    rows = [("c", "g", "t", 0, T0 + dt.timedelta(seconds=10 * i), 100 * i - lag, 100 * i) for i, lag in enumerate(lags, 1)]
    batch = incidents(evaluate(samples_from(spark.createDataFrame(rows, COLS)), th), th)
    root = str(tmp_path)
    mon = StreamingMonitor(spark, th, f"{root}/out")
    for i, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, COLS).write.parquet(f"{root}/in/s={i}")
        run_available(spark, mon, f"{root}/in/*/")
    assert sorted(r.id for r in mon.events().select("id").collect()) == sorted(r.id for r in batch.select("id").collect())
    assert mon.events().filter("type = 'lag_cleared'").count() == 1


def test_event_consumption_stream(spark, tmp_path):
    from tidewater.operators import consume as CS
    from tidewater.sources import event_io as EIO
    good = '{"id":"1","type":"lag_cleared","severity":"info","current_lag":0}'
    env = spark.createDataFrame([(good, "lag_cleared", "info", "c", "g", "t", "0", 1),
                                 ("{bad", "x", "info", "c", "g", "t", "0", 1)],
                                "event string, type string, severity string, cluster string, group_id string, "
                                "topic string, partition string, timestamp bigint")
    env.write.parquet(f"{tmp_path}/events/batch_id=0")
    seen = []
    run = CS.fan_out([lambda df, bid: seen.append(CS.log_handler_lines(df).first().line)], f"{tmp_path}/rejects")
    q = (EIO.read_events_stream(spark, f"{tmp_path}/events").writeStream
         .foreachBatch(lambda df, bid: run(df, bid))
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert seen == ["[EVENT] Type: lag_cleared, Severity: info, Lag: 0"]
    rejects = spark.read.parquet(f"{tmp_path}/rejects").select("event", "reject_reason").collect()
    assert [tuple(r) for r in rejects] == [("{bad", "invalid payload")]
