"""Window snapshots (S9, S10): the last N records of every key.

A snapshot row is (KEY, records ARRAY<STRUCT<ts_us, committed_offset,
high_watermark, lag>>, saved_at_us), with the order of arrival `seq` after
ts_us where the samples have one.  The array is bounded by the window
size N, so building it is a bounded per-key aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.evaluate import tie_order

RECORD_FIELDS = ["ts_us", "committed_offset", "high_watermark", "lag"]


def tail_rows(samples: DataFrame, n: int, bucket_s: float = 86400.0) -> DataFrame:
    """The last `n` windowed samples per key (offset and end offset known).

    Two-phase so a key with a long history is never ranked in one task:
    the last `n` per (key, time bucket) first, then the last `n` per key
    among those candidates (at most n x buckets per key)."""
    win = samples.filter(F.col("committed_offset").isNotNull() & F.col("high_watermark").isNotNull())
    b = F.floor(F.col("ts_us") / F.lit(int(bucket_s * 1_000_000)))
    newest = [F.col(c).desc() for c in ("ts_us", *tie_order(samples))]
    w1 = Window.partitionBy(*S.KEY, "_b").orderBy(*newest)
    cand = (win.withColumn("_b", b).withColumn("_rn", F.row_number().over(w1))
            .filter(F.col("_rn") <= n).drop("_rn", "_b"))
    w2 = Window.partitionBy(*S.KEY).orderBy(*newest)
    return cand.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n).drop("_rn")


def save_windows(samples: DataFrame, window_size: int, saved_at_us: int | Column) -> DataFrame:
    """Per key its latest `window_size` records, oldest first; keys
    without records produce no row."""
    t = tail_rows(samples, window_size)
    fields = [*RECORD_FIELDS[:1], *(["seq"] if "seq" in samples.columns else []), *RECORD_FIELDS[1:]]
    rec = F.struct(*fields)
    saved = F.lit(saved_at_us) if isinstance(saved_at_us, int) else saved_at_us
    return (t.groupBy(*S.KEY).agg(F.sort_array(F.collect_list(rec)).alias("records"))
            .withColumn("saved_at_us", saved.cast("long")))


def load_windows(snapshot: DataFrame, as_of_us: int | Column, ttl_s: float = 86400.0) -> DataFrame:
    """Snapshot rows not older than the TTL, unnested back to samples
    (KEY, ts_us, committed_offset, high_watermark, lag)."""
    as_of = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    fresh = snapshot.filter((as_of - F.col("saved_at_us")) <= F.lit(int(ttl_s * 1_000_000)))
    return fresh.select(*S.KEY, F.inline("records"))

