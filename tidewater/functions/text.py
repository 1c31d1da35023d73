"""Text helpers: Go-style duration text (X1), status messages (W11), event
titles and log lines (E6, X10), composite key text (X8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Message templates of the monitored system, verbatim.
# ---------------------------------------------------------------------------
MSG_INSUFFICIENT = "Insufficient data: %d/%d records"
MSG_IDLE_EMPTY = "Consumer is caught up and idle"
MSG_STOPPED = "Consumer stopped for %s with lag %d"
MSG_STALLED_IDLE = "Consumer stalled for %s"
MSG_STALLED_SLOW = "Very slow consumption: %.2f msg/s"
MSG_ACTIVE_EMPTY = "Consumer is actively processing and caught up"
MSG_LAGGING = "Lag increasing rapidly at %.2f msg/s"
MSG_ACTIVE = "Processing at %.2f msg/s with lag %d"
MSG_RAPID = "Lag increasing rapidly at %.0f msg/s (threshold: %.0f msg/s)"
MSG_CLEARED = "Consumer has cleared significant lag"
TITLE = "Kafka Consumer %s: %s"
LOG_LINE = "[EVENT] Type: %s, Severity: %s, Lag: %d"


def _s(x: Column) -> Column:
    return x.cast("long").cast("string")


def duration_text_rounded(seconds: Column) -> Column:
    """X1 (message form): duration rounded half away from zero to whole
    seconds, printed like `45s`, `1m30s`, `2h0m0s`, `0s`."""
    r = F.floor(F.abs(seconds) + F.lit(0.5)).cast("long")
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    h, m, s = F.floor(r / 3600), F.floor((r % 3600) / 60), r % 60
    body = (F.when(r == 0, F.lit("0"))
            .when(h > 0, F.concat(_s(h), F.lit("h"), _s(m), F.lit("m"), _s(s)))
            .when(m > 0, F.concat(_s(m), F.lit("m"), _s(s)))
            .otherwise(_s(s)))
    return F.when(r == 0, F.lit("0s")).otherwise(F.concat(sign, body, F.lit("s")))


def _frac(us_part: Column, width: int) -> Column:
    """'.ddd' with trailing zeros removed, '' when zero."""
    txt = F.regexp_replace(F.lpad(_s(us_part), width, "0"), "0+$", "")
    return F.when(us_part == 0, F.lit("")).otherwise(F.concat(F.lit("."), txt))


def duration_text_us(us: Column) -> Column:
    """X1 (raw form): a duration given in microseconds printed the Go way:
    `0s`, `750µs`, `1.5ms`, `3h0m0s`, `1m0.5s`."""
    a = F.abs(us)
    sign = F.when(us < 0, F.lit("-")).otherwise(F.lit(""))
    secs = F.floor(a / 1_000_000)
    frac = a % 1_000_000
    h, m, s = F.floor(secs / 3600), F.floor((secs % 3600) / 60), secs % 60
    sec_txt = F.concat(_s(s), _frac(frac, 6), F.lit("s"))
    big = (F.when(h > 0, F.concat(_s(h), F.lit("h"), _s(m), F.lit("m"), sec_txt))
           .when(m > 0, F.concat(_s(m), F.lit("m"), sec_txt))
           .otherwise(sec_txt))
    small = (F.when(a < 1000, F.concat(_s(a), F.lit("µs")))
             .otherwise(F.concat(_s(F.floor(a / 1000)), _frac(a % 1000, 3), F.lit("ms"))))
    return (F.when(a == 0, F.lit("0s"))
            .otherwise(F.concat(sign, F.when(a < 1_000_000, small).otherwise(big))))


def key_text(cluster: Column, group: Column) -> Column:
    """`cluster/group` composite text."""
    return F.concat_ws("/", cluster, group)


def split_key_text(text: Column) -> tuple[Column, Column]:
    """X8 inverse: split at the first '/', the group id may contain more."""
    parts = F.split(text, "/", 2)
    return parts.getItem(0), parts.getItem(1)


def log_line(type_: Column, severity: Column, lag: Column) -> Column:
    """The log handler's line for one consumed event."""
    return F.format_string(LOG_LINE, type_, severity, lag)
