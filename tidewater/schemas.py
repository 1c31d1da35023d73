"""Column names, enums and fixed values shared by every operator.

KEY is the identity of one monitored work queue: a (cluster, consumer group,
topic, partition).  It is always carried as separate columns, never as a
joined string, so group ids containing ':' or '/' need no escaping.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["cluster", "group_id", "topic", "partition"]
GROUP_KEY = ["cluster", "group_id"]
LOG_KEY = ["cluster", "topic", "partition"]

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the monitored system's values for results
# to agree (status/trend/health vocabularies, their numeric codes, event
# types and severities).  Stated plainly, in natural order.
# ---------------------------------------------------------------------------
ACTIVE = "ACTIVE"
LAGGING = "LAGGING"
STALLED = "STALLED"
STOPPED = "STOPPED"
EMPTY = "EMPTY"
UNKNOWN = "UNKNOWN"

INCREASING = "INCREASING"
DECREASING = "DECREASING"
STABLE = "STABLE"

GOOD = "GOOD"
WARNING = "WARNING"
CRITICAL = "CRITICAL"

# status code: ACTIVE 0, LAGGING 1, STALLED 2, STOPPED 3, EMPTY 4, other -1
STATUS_CODES = {ACTIVE: 0, LAGGING: 1, STALLED: 2, STOPPED: 3, EMPTY: 4}
# trend code: STABLE 1, INCREASING 2, DECREASING 3, other 0
TREND_CODES = {STABLE: 1, INCREASING: 2, DECREASING: 3}
# health code: GOOD 0, WARNING 1, CRITICAL 2, other -1
HEALTH_CODES = {GOOD: 0, WARNING: 1, CRITICAL: 2}

CONSUMER_STOPPED = "consumer_stopped"
CONSUMER_STALLED = "consumer_stalled"
RAPID_LAG_INCREASE = "rapid_lag_increase"
CONSUMER_RECOVERED = "consumer_recovered"
LAG_CLEARED = "lag_cleared"
EVENT_TYPES = [CONSUMER_STOPPED, CONSUMER_STALLED, RAPID_LAG_INCREASE,
               CONSUMER_RECOVERED, LAG_CLEARED]

SEV_INFO = "info"
SEV_WARNING = "warning"
SEV_CRITICAL = "critical"

NO_COMMIT_MESSAGE = "No committed offset"
# Seconds from 0001-01-01 to 1970-01-01: time truncation counts multiples
# of the window from year 1, not from the unix epoch.
YEAR_ONE_OFFSET_S = 62135596800

# Dashboard label text per status code (display mapping).
STATUS_LABELS = {0: "Active", 1: "Lagging", 2: "Stalled", 3: "Stopped", 4: "Empty", -1: "Unknown"}
TREND_LABELS = {1: "Stable", 2: "Increasing", 3: "Decreasing", 0: "Unknown"}
HEALTH_LABELS = {0: "Good", 1: "Warning", 2: "Critical", -1: "Unknown"}

# Our own label for the event "source" field (configurable per call).
DEFAULT_EVENT_SOURCE = "tidewater"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
POSITIONS = T.StructType([
    T.StructField("cluster", T.StringType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("committed_offset", T.LongType()),
])

WATERMARKS = T.StructType([
    T.StructField("cluster", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("high_watermark", T.LongType()),
])

GROUP_MEMBERS = T.StructType([
    T.StructField("cluster", T.StringType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("members", T.IntegerType()),
])

RECORD = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("committed_offset", T.LongType()),
    T.StructField("high_watermark", T.LongType()),
    T.StructField("lag", T.LongType()),
])

EVENT_DATA = T.MapType(T.StringType(), T.StringType())

# Envelope columns of the event sink; `event` holds the JSON payload.
ENVELOPE_COLUMNS = ["event", "type", "severity", "cluster", "group_id", "topic",
                    "partition", "timestamp"]

# JSON payload schema, used to parse the `event` column back.
EVENT_PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("cluster", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("data", EVENT_DATA),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("consumer_group", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("current_lag", T.LongType()),
    T.StructField("current_offset", T.LongType()),
    T.StructField("high_watermark", T.LongType()),
    T.StructField("lag_delta", T.LongType()),
    T.StructField("offset_delta", T.LongType()),
    T.StructField("consumption_rate", T.DoubleType()),
    T.StructField("lag_change_rate", T.DoubleType()),
    T.StructField("time_since_last_move", T.StringType()),
])
