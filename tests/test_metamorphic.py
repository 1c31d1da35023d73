"""Metamorphic properties: row order does not matter, and a
second cluster does not change the first one's statuses or events."""

import os

import pytest
from pyspark.sql import functions as F

from tidewater.config import B_SHORT
from tidewater.operators.evaluate import evaluate
from tidewater.operators.incidents import detect
from tidewater.plans import monitor as M

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
COLS = ["cluster", "group_id", "topic", "partition", "ts_us", "status", "lag_trend", "health",
        "consumption_rate", "time_since_last_move_s"]


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_permutation_and_second_cluster(spark):
    s = M.samples_b(spark, SF).cache()
    base = evaluate(s, B_SHORT, messages=False)
    shuffled = s.orderBy(F.rand(7)).repartition(5)
    assert _rows(evaluate(shuffled, B_SHORT, messages=False), COLS) == _rows(base, COLS)
    other = s.withColumn("cluster", F.lit("copy")).withColumn(
        "committed_offset", F.col("committed_offset") + F.lit(1))
    both = evaluate(s.unionByName(other), B_SHORT, messages=False)
    assert _rows(both.filter(F.col("cluster") == "events"), COLS) == _rows(base, COLS)
    ev_cols = ["cluster", "group_id", "partition", "ts_us", "event_type"]
    assert _rows(detect(both, B_SHORT).filter(F.col("cluster") == "events"), ev_cols) == \
        _rows(detect(base, B_SHORT), ev_cols)
    s.unpersist()
