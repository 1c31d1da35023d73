"""Event consumption (C1-C4): parse, quarantine, fan out to handlers.

Parsing is `from_json` in PERMISSIVE mode with a corrupt-record column, so
bad payloads become rows of a quarantine table with a reason instead of
failing the batch (the reference leaves them unacknowledged; here the
stream moves on - documented change).  Handlers run in `foreachBatch` on a
persisted batch; a failing handler is reported and the others still run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import text as X

log = logging.getLogger(__name__)

CORRUPT = "_corrupt"
Handler = Callable[[DataFrame, int], None]


def parse(envelopes: DataFrame) -> DataFrame:
    """C1 + C2: envelope -> typed payload columns + `reject_reason`
    (NULL for good rows): missing payload, not JSON, wrong field type."""
    schema = T.StructType(S.EVENT_PAYLOAD.fields + [T.StructField(CORRUPT, T.StringType())])
    p = F.from_json(F.col("event"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # a generator of one row: what reads `p` (filters too) reads the one result
    # and does not parse, or build the payload, again
    df = envelopes.select("*", F.inline(F.array(F.struct(p.alias("p")))))
    reason = (F.when(F.col("event").isNull() | (F.trim(F.col("event")) == ""), F.lit("missing payload"))
              .when(F.col(f"p.{CORRUPT}").isNotNull(), F.lit("invalid payload")))
    return df.withColumn("reject_reason", reason)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select(
        *[F.col(f"p.{f.name}").alias(f.name) for f in S.EVENT_PAYLOAD.fields])


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected envelopes with their reason."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        "event", "type", "cluster", "group_id", "topic", "partition", "timestamp", "reject_reason")


def log_handler_lines(events: DataFrame) -> DataFrame:
    """The log handler's output as rows."""
    return events.select(X.log_line(F.col("type"), F.col("severity"), F.col("current_lag")).alias("line"))


def fan_out(handlers: list[Handler], quarantine_path: str) -> Callable[[DataFrame, int], dict]:
    """C2 + C3: a foreachBatch function that first writes the batch's rejects
    under `quarantine_path` (one folder per batch id, overwritten by a
    replay) and then calls every handler on the accepted events.  The parsed
    batch is persisted once; an exception in one handler is logged and the
    rest run.  Returns {handler index: error text} for failed handlers."""
    def run(batch: DataFrame, batch_id: int) -> dict:
        good = parse(batch).persist()
        errors = {}
        try:
            quarantine(good).write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
            for i, h in enumerate(handlers):
                try:
                    h(accepted(good), batch_id)
                except Exception as ex:  # noqa: BLE001 - a handler must not stop the others
                    log.warning("handler %d failed on batch %d: %s", i, batch_id, ex)
                    errors[i] = str(ex)
        finally:
            good.unpersist()
        return errors
    return run
