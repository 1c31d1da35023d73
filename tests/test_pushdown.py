"""Filters and projections reach the parquet scan (P5, Q2, Q10)."""

from pyspark.sql import functions as F


from tidewater.plans import reports as RP


def test_group_filter_is_pushed_to_parquet(spark, tmp_path):
    df = spark.createDataFrame([("c1", "g1", 1, 10), ("c2", "g2", 2, 20)],
                               "cluster string, group_id string, ts_us long, total_lag long")
    df.write.parquet(str(tmp_path / "groups"))
    t = spark.read.parquet(str(tmp_path / "groups"))
    q = RP.cluster_status(t, "c1").select("group_id", "total_lag")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cluster), EqualTo(cluster,c1)]" in plan
    assert "ReadSchema: struct<cluster:string,group_id:string,total_lag:bigint>" in plan
    assert [tuple(r) for r in q.collect()] == [("g1", 10)]


def test_latest_table_keeps_silent_keys(spark, tmp_path):
    from tidewater.sources import status_io as SIO
    path, cols = str(tmp_path / "latest"), "cluster string, group_id string, ts_us long, status string"
    runs = [[("c", "old", 5, "A"), ("c", "new", 6, "A")], [("c", "new", 900, "B"), ("c", "old", 4, "late")],
            [("c", "new", 900, "C")]]
    for i, r in enumerate(runs):
        SIO.update_latest(spark.createDataFrame(r, cols), path, i, ["cluster", "group_id"])
    got = {r.group_id: (r.ts_us, r.status) for r in SIO.read_latest(spark, path).collect()}
    assert got == {"old": (5, "A"), "new": (900, "C")}
    SIO.update_latest(spark.createDataFrame(runs[1], cols), path, 1, ["cluster", "group_id"])     # a replay
    assert {r.status for r in spark.read.parquet(f"{path}/v=1").collect()} == {"A", "B"}


def test_status_table_prunes_by_cluster_and_day(spark, tmp_path):
    from tidewater.sources import status_io as SIO
    day = 86_400 * 1_000_000
    rows = [("c1", "g", "t", 0, d * day + 5, "ACTIVE") for d in (19000, 19001, 19002)] + \
           [("c2", "g", "t", 0, 19002 * day + 7, "EMPTY")]
    df = spark.createDataFrame(rows, "cluster string, group_id string, topic string, partition int, "
                                     "ts_us long, status string")
    path = str(tmp_path / "status")
    SIO.write_status(df, path)
    q = SIO.read_status(spark, path).filter("cluster = 'c1' and day = 19002")
    assert [(r.cluster, r.day) for r in q.collect()] == [("c1", 19002)]
    plan = q._jdf.queryExecution().executedPlan().toString()
    import re
    assert re.search(r"PartitionFilters: \[[^\]]*\(cluster#\d+ = c1\)[^\]]*\(day#\d+ = 19002", plan)
    # re-writing one day replaces only that partition
    SIO.write_status(df.filter("ts_us > 19002 * 86400000000").withColumn("status", F.lit("STOPPED")), path)
    allrows = SIO.read_status(spark, path)
    assert allrows.count() == 4 and allrows.filter("status = 'STOPPED'").count() == 2
