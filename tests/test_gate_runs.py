"""The array fold against a row-by-row fold, and the plan of per-cluster thresholds."""

import numpy as np
import pytest

from tidewater.config import B_LONG, attach_thresholds, thresholds_frame
from tidewater.operators.gate_runs import EV_CLEARED, EV_RAPID, NEVER, NONE, GateRuns
from tidewater.operators.incidents import transition_code


def by_row(ts, st, e4, e5, gate, prev, last):
    out = []
    for i, t in enumerate(ts):
        if last > NEVER and t - last < gate:
            continue
        code = int(transition_code(np.array([prev]), st[i:i + 1])[0])
        out += [(i, c) for c in (code, EV_RAPID * e4[i], EV_CLEARED * e5[i]) if c]
        prev = int(st[i])
        if code or e4[i]:
            last = int(t)
    return out, prev, last


@pytest.mark.parametrize("seed", range(30))
def test_all_runs_of_a_batch_at_once(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 25, 12)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    n = int(sizes.sum())
    ts = np.concatenate([np.cumsum(rng.choice([0, 1, 2, 9], k)) for k in sizes])
    st, e4, e5 = rng.integers(-1, 5, n), rng.random(n) < .1, rng.random(n) < .2
    gate = rng.choice([0, 3, 10], len(sizes))
    prev = rng.choice([NONE, -1, 0, 2, 3], len(sizes))
    last = np.where(prev == NONE, NEVER, rng.choice([NEVER, -2, -20], len(sizes)))
    runs = GateRuns(starts, ts, st, e4, e5, gate, transition_code)
    rows, codes, got_prev, got_last = runs.fold(prev, last)
    through = runs.through(np.arange(len(sizes)), prev, last, runs.last_on_chain())
    want = []
    for r, (a, k) in enumerate(zip(starts, sizes)):
        s = slice(a, a + k)
        ev, p, at = by_row(ts[s], st[s], e4[s], e5[s], gate[r], int(prev[r]), int(last[r]))
        want += [(a + i, c) for i, c in ev]
        assert (got_prev[r], got_last[r]) == (through[0][r], through[1][r]) == (p, at)
    assert list(zip(rows.tolist(), codes.tolist())) == want


def test_samples_are_not_shuffled_by_cluster(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        th = thresholds_frame(spark, {"c": B_LONG})
        samples = spark.range(10).selectExpr("concat('c', id % 2) AS cluster", "id AS ts_us")
        plan = attach_thresholds(samples, th)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
