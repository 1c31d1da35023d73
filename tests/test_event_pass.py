"""The event pass: one shuffle from samples to event records, the payload
through the fold, messages for events only, one parse of each payload."""

import re

import pytest
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.config import Thresholds
from tidewater.operators import consume as CS
from tidewater.operators.evaluate import evaluate
from tidewater.operators.incidents import detect, event_records
from tidewater.sources import event_io as EIO
from tidewater.sources.bridges import bridge_events
from tidewater.sources.positions import samples_from

TH = Thresholds(window_size=5, min_size=2, stalled_rate=0.5, rapid_rate=1.0, inactivity_s=25.0,
                lag_floor=5, gate_s=5.0, dedup_s=300.0)


def _samples(spark, keys=6, n=40):
    offs = {(k, i): (i // (k + 2)) * 7 * ((i // 9) % 2) + 40 * (i // 18) for k in range(keys) for i in range(n)}
    rows = [("c", f"g{k % 2}", "t", k, 10 * i, None if i < k else off, off + (13 * i * (k + 1)) % 31 * (i % 7 > 2))
            for (k, i), off in offs.items()]
    df = spark.createDataFrame(rows, "cluster string, group_id string, topic string, partition int, s long, committed_offset long, high_watermark long")
    return samples_from(df.select(*S.KEY, F.timestamp_micros(F.col("s") * 1_000_000).cast("timestamp_ntz").alias("ts"),
                                  "committed_offset", "high_watermark"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_payload_through_the_fold_equals_the_joined_payload(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        s = _samples(spark)
        whole = evaluate(s, TH)
        joined = event_records(whole, detect(whole, TH), TH)
        ev = evaluate(s, TH, messages=False)
        carried = event_records(ev, detect(ev, TH, payload=True), TH)
        key = lambda r: (r.id, r.ts_us)
        got, want = sorted(carried.collect(), key=key), sorted(joined.collect(), key=key)
        assert got == want and len(got) > 10
        assert {r.type for r in got} >= {S.CONSUMER_STALLED, S.CONSUMER_RECOVERED} and all(r.description for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_events_of_samples_take_one_shuffle_and_no_join(spark):
    ev = evaluate(_samples(spark), TH, messages=False)
    plan = _plan(event_records(ev, detect(ev, TH, payload=True), TH))
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_a_payload_is_parsed_once(spark):
    ev = evaluate(_samples(spark), TH, messages=False)
    env = EIO.envelope(event_records(ev, detect(ev, TH, payload=True), TH))
    bad = CS.quarantine(CS.parse(env.withColumn("event", F.when(F.col("severity") == "info", F.expr("substring(event, 1, 9)")).otherwise(F.col("event")))))
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert {r.reject_reason for r in bad.collect()} == {"invalid payload"}


def test_bridge_holds_values_between_messages(spark):
    events = spark.createDataFrame([(0, 0.5, 0, "a"), (1, 0.6, 0, "b"), (2, 3.2, 0, "a"), (3, 2.1, 1, "b"), (4, 5.0, 1, "b")],
                                   "event_id long, h double, user_id long, event_type string")
    events = events.withColumn("ts", F.timestamp_micros((F.col("h") * 3_600_000_000).cast("long")).cast("timestamp_ntz"))
    pos, wm = bridge_events(events, partitions=2)
    def series(df, *by):
        out = {}
        for r in df.orderBy("ts").collect():
            out.setdefault(tuple(r[c] for c in by), []).append(r[-1])
        return out
    assert series(wm, "partition") == {(0,): [2, 2, 2, 3, 3, 3], (1,): [0, 0, 1, 1, 1, 2]}
    assert series(pos, "group_id", "partition") == {("a", 0): [1, 1, 1, 3, 3, 3], ("b", 0): [2, 2, 2, 2, 2, 2],
                                                    ("b", 1): [None, None, 1, 1, 1, 2]}
    dense = [m for m in re.findall(r"Generate explode.*", _plan(pos))]
    assert len(dense) == 1 and "Window" not in _plan(pos).split("Generate explode")[0]
