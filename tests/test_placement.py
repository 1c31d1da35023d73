"""Placement and membership (K1-K5, L1-L3)."""

from pyspark.sql import functions as F

from tidewater.operators import placement as PL


def _members(spark, names):
    return spark.createDataFrame([(n,) for n in names], "member string")


def _keys(spark, n):
    return spark.createDataFrame([(f"k{i}",) for i in range(n)], "key string")


def test_assignments(spark):
    assert PL.assign(_keys(spark, 6), _members(spark, [])).count() == 0
    one = PL.assign(_keys(spark, 6), _members(spark, ["a"])).collect()
    assert {r.owner for r in one} == {"a"} and len(one) == 6
    m = _members(spark, ["a", "b", "c"])
    lists = PL.assignment_lists(PL.assign(_keys(spark, 6), m), m)
    assert lists.filter(F.col("key").isNotNull()).count() == 6
    assert {r.member for r in lists.collect()} == {"a", "b", "c"}
    empty = PL.assignment_lists(PL.assign(_keys(spark, 0), m), m).collect()
    assert len(empty) == 3 and all(r.key is None for r in empty)


def test_settings_fallback():
    s = PL.PlacementSettings(0, -1, 0).normalized()
    assert (s.partition_count, s.replication, s.load) == (997, 20, 1.25)


def test_churn_moves_only_departed_keys(spark):
    k, m = _keys(spark, 200), _members(spark, ["a", "b", "c", "d"])
    before = PL.assign(k, m)
    after = PL.assign(k, m.filter("member <> 'b'"))
    moved = PL.churn(before, after).first().moved
    assert moved == before.filter("owner = 'b'").count()


def test_active_members_and_expiry(spark):
    now = 1_000_000_000_000
    hb = spark.createDataFrame([("a", now, "active", 1), ("b", now - 180_000_000, "active", 1),
                                ("c", now - 30_000_000, "active", 1), ("d", now, "offline", 0)],
                               "id string, ts_us long, status string, assigned_count int")
    cur = PL.current_members(hb, now)
    assert {r.id for r in PL.active_members(cur, now, 120.0).collect()} == {"a", "c"}


def test_assignment_snapshot_skips_bad_json(spark):
    snap = spark.createDataFrame([("a", '["k1","k2"]', 100), ("b", "not json", 100)],
                                 "member string, keys_json string, saved_at_us long")
    assert sorted(r.key for r in PL.read_assignments(snap, 200).collect()) == ["k1", "k2"]
    assert PL.read_assignments(snap, 100 + 601_000_000).count() == 0


def test_integer_ttls_do_not_overflow(spark):
    now = 10_000_000_000_000
    hb = spark.createDataFrame([("a", now - 86_400_000_000, "active", 1)],
                               "id string, ts_us long, status string, assigned_count int")
    assert PL.current_members(hb, now, ttl_s=30 * 86400, offline_ttl_s=7 * 86400).count() == 1
