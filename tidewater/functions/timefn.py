"""Time helpers: timezone-independent epoch arithmetic and tick alignment.

Inputs carry TIMESTAMP_NTZ (wall clock, no zone).  All arithmetic is done on
BIGINT epoch microseconds so it is exact and does not depend on the session
time zone; `timestamp_diff` on NTZ values ignores the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import YEAR_ONE_OFFSET_S

US = 1_000_000


def _epoch_ntz() -> Column:
    # string -> TIMESTAMP_NTZ is zone independent (a datetime literal is not)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_us(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (or TIMESTAMP) column."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c.cast("timestamp_ntz"))


def from_epoch_us(col: Column | str) -> Column:
    """TIMESTAMP_NTZ from epoch microseconds (zone independent)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MICROSECOND", c, _epoch_ntz())


def next_tick_us(ts_us: Column, step_us: int, origin_us: int = 0) -> Column:
    """First tick strictly after `ts_us` on the grid origin + k*step."""
    return ts_us - F.pmod(ts_us - F.lit(origin_us), F.lit(step_us)) + F.lit(step_us)


def floor_tick_us(ts_us: Column, step_us: int, origin_us: int = 0) -> Column:
    """Tick at or before `ts_us` (bucket start)."""
    return ts_us - F.pmod(ts_us - F.lit(origin_us), F.lit(step_us))


def truncate_from_year_one_s(ts_us: Column, window_s) -> Column:
    """Unix seconds of `ts` truncated to a multiple of `window_s` counted
    from 0001-01-01 (not from 1970).  Equals epoch bucketing only when the
    window divides 62 135 596 800 s."""
    # computed as a Python int (or a double column): an INT literal times
    # 10^6 would overflow under ANSI arithmetic
    w_us = (F.lit(int(round(float(window_s) * US))).cast("long") if not isinstance(window_s, Column)
            else (window_s.cast("double") * US).cast("long"))
    shifted = ts_us + F.lit(YEAR_ONE_OFFSET_S * US)
    return F.floor((shifted - F.pmod(shifted, w_us)) / US).cast("long") - F.lit(YEAR_ONE_OFFSET_S)
