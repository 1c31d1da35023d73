"""Counters kept over runs, day sketches, retention and one evaluation for all gauges."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater.operators import rollup as R
from tidewater.operators.ranking import numbered
from tidewater.plans.catalog import QUERIES
from tidewater.session import checkpoint_path
from tidewater.sources.event_io import retain_latest, update_retained
from tidewater.sources.series import CumulativeSeries
from tidewater.sources.status_io import read_latest


def folder(spark):
    return checkpoint_path(spark, f"test-{uuid.uuid4().hex}")


def durations(spark, n=300, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([("c", f"g{r.randrange(4)}", i, r.choice([0.004, 0.005, 0.3, 2.5, 11.0, 400.0])) for i in range(n)],
                                 "cluster string, group_id string, run_row int, duration_s double")


def test_merged_runs_equal_one_run(spark):
    rows = durations(spark)
    names = [*(f"le_{i}" for i in range(len(R.DEFAULT_BUCKETS))), "count"]
    series = CumulativeSeries(spark, folder(spark), ["cluster", "group_id"], names)
    with pytest.raises(ValueError):
        series.total()
    want = sorted(R.duration_counters(rows).select("cluster", "group_id", *names).collect())
    for run in range(5):
        part = R.duration_counters(rows.filter(F.col("run_row") % 5 == run))
        series.add(part, run)
        series.add(part, run)                                       # a replay replaces its own rows
        if run == 2:
            series.compact()
            series.add(part, run)                                   # already in the base
            series.compact()
    assert sorted(series.total().select("cluster", "group_id", *names).collect()) == want
    series.compact()
    assert sorted(series.total().select("cluster", "group_id", *names).collect()) == want


def test_a_run_without_rows(spark):
    series = CumulativeSeries(spark, folder(spark), ["cluster"], ["errors"])
    series.add(spark.createDataFrame([], "cluster string, errors long"), 0)
    assert series.total().count() == 0
    series.add(spark.createDataFrame([("a", 2), (None, 1)], "cluster string, errors long"), 1)
    assert sorted(series.total().collect(), key=str) == [("a", 2), (None, 1)]


def test_edges_of_the_default_buckets(spark):
    got = {r["le"]: r["n"] for r in R.duration_histogram(
        spark.createDataFrame([("c", "g", 0.005), ("c", "g", 0.0051), ("c", "g", 10.0), ("c", "g", 10.1)],
                              "cluster string, group_id string, duration_s double")).collect()}
    assert (got["0.005"], got["0.01"], got["5.0"], got["10.0"], got["+Inf"]) == (1, 2, 2, 3, 4)


def test_sketches_unite_over_days(spark):
    day = 86_400 * 1_000_000
    rows = spark.range(60_000).select(
        F.lit("c").alias("cluster"), F.concat(F.lit("g"), F.col("id") % 40_000).alias("group_id"),
        (F.col("id") % 6 * day).alias("ts_us"))
    sketches = R.group_sketches(rows)
    assert sketches.count() == 6
    both = sketches.unionByName(R.group_sketches(rows.filter("ts_us > 0")))
    for first, last in ((None, None), (0, 2), (3, 3)):
        part = rows.filter(F.col("ts_us").between((first or 0) * day, (5 if last is None else last) * day))
        true = part.select("group_id").distinct().count()
        got = R.groups_in_days(sketches, first, last).head().groups
        assert abs(got - true) <= 4 * 0.0065 * true
        assert R.groups_in_days(both, first, last).head().groups == got     # a day twice counts once


def brute_newest(rows, k):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)[:k]


@pytest.mark.parametrize("k", [0, 1, 7, 50, 199, 200, 500])
@pytest.mark.parametrize("buckets", [1, 4, 1024])
def test_retention_against_a_sort(spark, k, buckets):
    r = random.Random(k)
    rows = [(r.choice([None, 5, 5, 5, 900, r.randrange(10_000), -3]), f"e{i:04d}") for i in range(200)]
    df = spark.createDataFrame(rows, "t long, id string").repartition(3)
    got = [tuple(x) for x in retain_latest(df, k, "t", "id", buckets).collect()]
    assert sorted(got, key=str) == sorted(brute_newest(rows, k), key=str)


def test_retention_has_no_top_k_and_versions_switch(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 1000).alias("t"), F.col("id").cast("string").alias("id"))
    plan = retain_latest(df, 500, "t", "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    path = folder(spark)
    for run in (0, 1, 1):
        update_retained(df.filter(F.col("id") % 2 == run), path, run, 500, "t", "id")
    want = brute_newest([tuple(r) for r in df.collect()], 500)
    assert sorted(tuple(r) for r in read_latest(spark, path).collect()) == sorted(want)
    assert retain_latest(df.filter("false"), 5, "t", "id").count() == 0


def test_positions_are_dense(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "a int, b int").repartition(5)
    got = numbered(df, [F.col("a").desc()], folder(spark), "n", 10).collect()
    assert sorted((r.n, r.a) for r in got) == [(10 + 101 - a, a) for a in reversed(range(101))]


def test_gauges_come_from_one_evaluation(spark):
    """The gauges read checkpointed rows per key and the events written rows:
    the evaluation's window is in neither plan."""
    for name in ("s8_metrics_long", "e7_events_dedup"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan
