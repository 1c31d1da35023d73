"""Hot-key threshold policy shared by the split window pass and the split
gate fold.

`hot_key_rows` may be an int (fixed threshold), None (no splitting) or
"auto": a key is hot when it holds more rows than one shuffle partition's
fair share - total rows / spark.sql.shuffle.partitions - and never fewer
than AUTO_FLOOR_ROWS, so small inputs are not split at all.

`find_hot_keys` decides the plan the way AQE would: one aggregate job finds
the hot keys.  Their number is bounded - in "auto" mode fewer than the
shuffle partition count, since each holds more than a 1/P share of the
rows - so the short list is brought back (at most MAX_COLLECTED keys) and
broadcast; without any hot key the cheap unsplit plan is used.  With a
fixed threshold and more hot keys than MAX_COLLECTED, the hot-key table
stays distributed; it is written once.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import written

AUTO = "auto"
AUTO_FLOOR_ROWS = 1_000_000
MAX_COLLECTED = 10_000


@dataclass(frozen=True)
class Auto:
    """Split keys above one shuffle partition's fair share of the rows, but
    none with fewer than `floor_rows`.  "auto" is Auto() with the default."""
    floor_rows: int = AUTO_FLOOR_ROWS


def hot_threshold(df: DataFrame, hot_key_rows: int | str | None) -> Column | None:
    if hot_key_rows is None:
        return None
    if hot_key_rows == AUTO:
        hot_key_rows = Auto()
    if isinstance(hot_key_rows, Auto):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        share = df.select(F.ceil(F.count(F.lit(1)) / F.lit(parts)).cast("long")).scalar()
        return F.greatest(share, F.lit(hot_key_rows.floor_rows).cast("long"))
    return F.lit(int(hot_key_rows)).cast("long")


def find_hot_keys(df: DataFrame, hot_key_rows: int | str | None) -> DataFrame | None:
    """KEY + (_nseg, _lo, _hi) of the hot keys, or None when there is none
    (or splitting is off)."""
    thr = hot_threshold(df, hot_key_rows)
    if thr is None:
        return None
    stats = df.groupBy(*S.KEY).agg(F.count(F.lit(1)).alias("_cnt"), F.min("ts_us").alias("_lo"),
                                   F.max("ts_us").alias("_hi"))
    hot = stats.filter(F.col("_cnt") > thr).select(
        *S.KEY, F.ceil(F.col("_cnt") / thr).alias("_nseg"), "_lo", "_hi")
    rows = hot.limit(MAX_COLLECTED + 1).collect()
    if not rows:
        return None
    if len(rows) > MAX_COLLECTED:
        return written(hot, f"hot-{uuid4().hex}")
    return F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema))


@dataclass(frozen=True)
class HotKeys:
    """A hot-key decision taken once and shared by the window pass and the
    gate fold (the keys hot among the samples are a superset of those hot
    among the windowed rows).  `table` is None when no key is hot."""
    table: DataFrame | None


def plan_hot_keys(df: DataFrame, hot_key_rows: int | str | None) -> HotKeys:
    return HotKeys(find_hot_keys(df, hot_key_rows))


def resolve(df: DataFrame, hot_key_rows) -> DataFrame | None:
    """hot_key_rows given as a number, "auto", None or a HotKeys decision."""
    if isinstance(hot_key_rows, HotKeys):
        return hot_key_rows.table
    return find_hot_keys(df, hot_key_rows) if hot_key_rows else None
