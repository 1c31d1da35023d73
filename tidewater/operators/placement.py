"""Key placement and membership as table operators (K1-K5, L1-L3).

Keys (e.g. consumer groups) hash to a fixed number of buckets; each bucket
gets an owner among the live members by rendezvous hashing (highest
md5(bucket|member) wins), which moves only the keys of a departed member.
The bucket->owner table has `partition_count` x members rows - bounded by
configuration, not by the number of keys - and is generated with
`sequence` + `explode` per member (no join), reduced with `max_by` per
bucket, and then equi-joined to the keys.  Bounded-load balancing of the
reference's ring library is not reproduced; `load_report` measures it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the placement settings and their fallbacks.
DEFAULT_PARTITION_COUNT = 997
DEFAULT_REPLICATION = 20
DEFAULT_LOAD = 1.25


@dataclass(frozen=True)
class PlacementSettings:
    partition_count: int = DEFAULT_PARTITION_COUNT
    replication: int = DEFAULT_REPLICATION
    load: float = DEFAULT_LOAD

    def normalized(self) -> "PlacementSettings":
        """Non-positive settings fall back to the defaults."""
        return PlacementSettings(
            self.partition_count if self.partition_count > 0 else DEFAULT_PARTITION_COUNT,
            self.replication if self.replication > 0 else DEFAULT_REPLICATION,
            self.load if self.load > 0 else DEFAULT_LOAD)


def key_bucket(key: Column, partition_count: int) -> Column:
    """K1: first 32 bits of md5(key) modulo the bucket count."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(partition_count)).cast("int")


def bucket_owners(members: DataFrame, settings: PlacementSettings = PlacementSettings()) -> DataFrame:
    """K2: (bucket, owner) for every bucket, empty when there is no member."""
    s = settings.normalized()
    grid = members.select(F.col("member"),
                          F.explode(F.sequence(F.lit(0), F.lit(s.partition_count - 1))).alias("bucket"))
    score = F.md5(F.concat_ws("|", F.col("bucket").cast("string"), F.col("member")))
    return grid.groupBy("bucket").agg(F.max_by("member", score).alias("owner"))


def assign(keys: DataFrame, members: DataFrame, settings: PlacementSettings = PlacementSettings()) -> DataFrame:
    """K2 applied to keys: (key, bucket, owner); each key exactly once.

    The owner table has one row per bucket; the planner measures it and
    broadcasts it only below its threshold."""
    s = settings.normalized()
    k = keys.select("key", key_bucket(F.col("key"), s.partition_count).alias("bucket"))
    return k.join(bucket_owners(members, s), "bucket", "inner").select("key", "bucket", "owner")


def assignment_lists(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """K3: every member appears, members without keys with a NULL key; long
    form (member, key) so no member's list is gathered into one row.  Keys are
    not shuffled: only the distinct owners meet the members."""
    owned = assigned.select(F.col("owner").alias("member"), "key")
    idle = members.select("member").join(owned.select("member").distinct(), "member", "left_anti")
    return owned.unionByName(idle.withColumn("key", F.lit(None).cast("string")))


def load_report(assigned: DataFrame, members: DataFrame,
                settings: PlacementSettings = PlacementSettings()) -> DataFrame:
    """K4: keys per member against load x average keys per member."""
    s = settings.normalized()
    per = assigned.groupBy(F.col("owner").alias("member")).agg(F.count(F.lit(1)).alias("keys"))
    m = members.select("member").join(per, "member", "left").withColumn("keys", F.coalesce("keys", F.lit(0)))
    avg = m.select((F.sum("keys") / F.count(F.lit(1))).alias("avg")).scalar()  # one scalar subquery
    return m.select("member", F.col("keys").cast("long"), (avg * s.load).alias("limit"),
                    (F.col("keys") > avg * s.load).alias("over_limit"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """K5: keys whose owner differs between two assignments (full outer join
    on key: keys present on one side only count as moved)."""
    b = before.select("key", F.col("owner").alias("owner_before"))
    a = after.select("key", F.col("owner").alias("owner_after"))
    j = b.join(a, "key", "full_outer")
    moved = ~F.coalesce(F.col("owner_before") == F.col("owner_after"), F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("keys"), F.count_if(moved).alias("moved"))


def current_members(heartbeats: DataFrame, now_us: Column | int, *, ttl_s: float = 300.0,
                    offline_ttl_s: float = 30.0) -> DataFrame:
    """L2: heartbeat log (id, ts_us, status, assigned_count, metadata) ->
    newest record per id, dropped once expired (TTL; shorter once offline).
    Takes the newest heartbeat as last_heartbeat (deliberate fix: the
    reference's heartbeat extends only the TTL)."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    cols = [c for c in heartbeats.columns if c not in ("id", "ts_us")]
    # newest record wins; equal times are broken by the remaining fields
    # (status, then the others) so the result is deterministic
    ordered = ["ts_us", "status"] + [c for c in cols if c != "status"]
    newest = (heartbeats.groupBy("id")
              .agg(F.max(F.struct(*ordered)).alias("r"))
              .select("id", F.col("r.ts_us").alias("last_heartbeat_us"), *[F.col(f"r.{c}").alias(c) for c in cols]))
    ttl = F.when(F.col("status") == "offline", F.lit(float(offline_ttl_s))).otherwise(F.lit(float(ttl_s)))
    return newest.filter((now - F.col("last_heartbeat_us")) < ttl * 1_000_000)


def active_members(members: DataFrame, now_us: Column | int, timeout_s: float = 120.0) -> DataFrame:
    """L1: status 'active' and now - last_heartbeat < timeout (strict)."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return members.filter((F.col("status") == "active")
                          & ((now - F.col("last_heartbeat_us")) < F.lit(timeout_s * 1_000_000)))


def read_assignments(snapshot: DataFrame, now_us: Column | int, timeout_s: float = 600.0) -> DataFrame:
    """L3: (member, keys_json, saved_at_us) -> (member, key).  Entries whose
    JSON does not parse are skipped; a snapshot whose newest entry is older
    than the timeout is refused as a whole (no rows)."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    parsed = snapshot.select("member", "saved_at_us",
                             F.from_json("keys_json", "array<string>").alias("keys"))
    saved = snapshot.select(F.max("saved_at_us")).scalar()
    fresh = parsed.filter((now - saved) <= F.lit(timeout_s * 1_000_000))
    return fresh.filter(F.col("keys").isNotNull()).select("member", F.explode("keys").alias("key"))
