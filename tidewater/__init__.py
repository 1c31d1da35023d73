"""tidewater: progress and backlog analytics on Spark.

Sampled committed/end offsets of many independent work queues go in
(batch tables or streams); per-key sliding-window status, group and
cluster rollups, incident events, metric tables and reports come out -
all as Spark DataFrames.
"""

from .config import Thresholds  # noqa: F401
from .schemas import KEY  # noqa: F401

__version__ = "0.1.0"
