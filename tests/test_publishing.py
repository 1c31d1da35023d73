"""Publish outcomes, consumer groups and the stream-stream join."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.config import Thresholds
from tidewater.operators.evaluate import evaluate
from tidewater.operators.incidents import detect
from tidewater.operators.publishing import AttemptFold, publish_attempts, transition_code
from tidewater.schemas import POSITIONS, WATERMARKS
from tidewater.sources.event_log import ConsumerGroup, EventLog
from tidewater.sources.positions import join_watermarks, samples_from
from tidewater.streaming.joins import run_join

import datetime as dt
import numpy as np

T0 = dt.datetime(2024, 1, 1)


def walk(rows, gate):
    """One row after the other: (row, code, outcome)."""
    prev = last = None
    known, out = {}, []
    for i, (ts, st, e4, e5, bucket, lookup, publish) in enumerate(rows):
        if last is not None and ts - last < gate:
            continue
        codes = [int(transition_code(np.array([prev]), np.array([st]))[0])] if prev is not None and prev != st else []
        for code in [c for c in codes if c] + [4] * e4 + [5] * e5:
            if not lookup and known.get(code) == bucket:
                got = "deduplicated"
            else:
                if not lookup:
                    known[code] = bucket
                got = "failed" if publish else "published"
            out.append((i, code, got))
            if code != 5 and got != "failed":
                last = ts
        prev = st
    return out


@pytest.mark.parametrize("seed", range(40))
def test_attempts_against_a_row_by_row_walk(seed):
    r = random.Random(seed)
    rows = [(10 * i, r.choice([0, 0, 1, 2, 3, 4]), r.random() < .2, r.random() < .1, i // 9, r.random() < .3, r.random() < .3) for i in range(120)]
    fold, got, at = AttemptFold(25), [], 0
    for size in (1, 50, 69):                                        # state carries over batches
        part = [np.array(c) for c in zip(*rows[at:at + size])]
        ts, st, e4, e5, bucket, lookup, publish = part
        change = transition_code(np.r_[fold.prev, st[:-1]], st)
        got += [(at + i, c, o) for i, c, o in fold.run(ts, st, change, e4, e5, bucket, lookup, publish)]
        at += size
    assert got == walk(rows, 25)
    assert {"published", "failed", "deduplicated"} >= {o for *_, o in got}


def test_no_failures_is_plain_detection(spark):
    th = Thresholds(window_size=4, min_size=2, stalled_rate=0.01, rapid_rate=5.0, inactivity_s=30.0, lag_floor=3, gate_s=20.0, dedup_s=1.0)
    rows = [("c", "g", "t", p, T0 + dt.timedelta(seconds=10 * s), (s * 3) // 2 if s % 7 < 4 else 6 * (s // 7), s * 2 + 1)
            for p in range(3) for s in range(60)]
    ev = evaluate(samples_from(spark.createDataFrame(rows, "cluster string, group_id string, topic string, partition int, ts timestamp_ntz, "
                                                           "committed_offset bigint, high_watermark bigint")), th)
    cols = ["partition", "ts_us", "event_type", "severity"]
    got = publish_attempts(ev, th, publish_failed=F.lit(False), lookup_failed=F.lit(None).cast("boolean"))
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, detect(ev, th).select(*cols).collect())) != []
    assert {r.outcome for r in got.select("outcome").collect()} == {"published"}
    down = publish_attempts(ev, th, publish_failed=F.lit(True), lookup_failed=F.lit(True))
    assert {r.outcome for r in down.select("outcome").collect()} == {"failed"} and down.count() >= got.count()


def test_groups_redeliver_until_acknowledged(spark, tmp_path):
    log = EventLog(spark, str(tmp_path))
    make = lambda lo, hi: spark.createDataFrame([(f"e{i}", (i * 7) % 11) for i in range(lo, hi)], "id string, ts_us long")
    group = ConsumerGroup(log, "a", 4)
    assert group.poll() is None and log.newest() == 0
    log.append(make(0, 10).repartition(3), 0)
    log.append(make(0, 10).repartition(5), 0)                       # a replayed run replaces itself
    assert log.newest() == 10
    n, events = group.poll()
    want = [r.id for r in make(0, 10).orderBy("ts_us", "id").collect()]
    assert n == 1 and [r.id for r in events.orderBy("seq").collect()] == want[:4]
    n, events = ConsumerGroup(log, "a", 4).poll()                   # restarted: the same batch
    assert n == 1 and [r.seq for r in events.orderBy("seq").collect()] == [1, 2, 3, 4]
    group.ack()
    group.ack()
    log.append(make(10, 13), 1)
    seen = []
    assert group.drain(lambda e, b: seen.append((b, sorted(r.seq for r in e.collect())))) == 3
    assert seen == [(2, [5, 6, 7, 8]), (3, [9, 10, 11, 12]), (4, [13])]
    assert ConsumerGroup(log, "b", 100).drain(lambda e, b: seen.append(e.count())) == 1 and seen[-1] == 13


def test_positions_and_end_offsets_meet_in_any_order(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    pos = [("c", "g", "t", 0, at(s), s) for s in range(0, 60, 10)]
    end = [("c", "t", 0, at(s), s + 5) for s in (0, 10, 30, 50)]
    far = 100_000
    files = [([pos[0]], end[2:]), (pos[1:4], end[:1]), (pos[4:], end[1:2])]
    files += [([("", "", "", 0, at(far + i), 0)], [("", "", 0, at(far + i), 0)]) for i in range(2)]
    for i, (p, w) in enumerate(files):
        spark.createDataFrame(p, POSITIONS).write.parquet(f"{tmp_path}/p/n={i}")
        spark.createDataFrame(w, WATERMARKS).write.parquet(f"{tmp_path}/w/n={i}")
        run_join(spark, f"{tmp_path}/p/*/", f"{tmp_path}/w/*/", f"{tmp_path}/out", 600)
    got = spark.read.parquet(f"{tmp_path}/out/samples").filter("cluster <> ''")
    want = join_watermarks(spark.createDataFrame(pos, POSITIONS), spark.createDataFrame(end, WATERMARKS))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
