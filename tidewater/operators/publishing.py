"""What happens when publishing an event fails.

An evaluated row may fire up to three events (status change, rapid lag, lag
cleared).  Each is an attempt:

* The de-duplication lookup may fail; the event is then published without
  being remembered.  Otherwise an event whose fingerprint (key, type, bucket
  of `dedup_s`) was remembered is `deduplicated`; else it is remembered.
* Publishing may fail: the attempt is `failed`.  It was remembered before, so
  a later one in the same bucket counts as a duplicate.
* Published and deduplicated attempts of the gate-setting types (all but lag
  cleared) set the gate; failed ones don't, while the row's status becomes
  the previous status all the same.

The fold streams each key's rows in order with (previous status, last event,
last bucket remembered per type) as its state, like `incidents.fold_gate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import Thresholds
from ..functions.timefn import truncate_from_year_one_s
from .incidents import _narrow_of, _typed, EV_CLEARED, EV_RAPID, GateFold, transition_code

PUBLISHED, DEDUPLICATED, FAILED = "published", "deduplicated", "failed"
_OUT = "cluster string, group_id string, topic string, partition int, ts_us long, tie int, ev int, outcome string"


class AttemptFold:
    """The state of one key."""

    def __init__(self, gate_us: int):
        self.gate_us, self.prev, self.last, self.known = gate_us, GateFold.NONE, None, {}

    def _attempt(self, code: int, bucket: int, lookup_failed: bool, publish_failed: bool) -> str:
        if not lookup_failed:
            if self.known.get(code) == bucket:
                return DEDUPLICATED
            self.known[code] = bucket
        return FAILED if publish_failed else PUBLISHED

    def run(self, ts, st, change, e4, e5, bucket, lookup_failed, publish_failed) -> list[tuple[int, int, str]]:
        """(row, event code, outcome) of the key's consecutive rows; `change`
        holds the event code of a change from the previous row's status."""
        out, i, n = [], 0, len(ts)
        busy = np.flatnonzero((change != 0) | e4 | e5)
        while i < n:
            if self.last is not None and ts[i] - self.last < self.gate_us:
                i = int(np.searchsorted(ts, self.last + self.gate_us))       # the previous status stays frozen
                if i >= n:
                    break
            codes = []
            if self.prev != GateFold.NONE and self.prev != st[i]:
                codes.append(int(transition_code(np.array([self.prev]), st[i:i + 1])[0]))
            codes += [EV_RAPID] * bool(e4[i]) + [EV_CLEARED] * bool(e5[i])
            for code in filter(None, codes):
                outcome = self._attempt(code, int(bucket[i]), bool(lookup_failed[i]), bool(publish_failed[i]))
                out.append((i, code, outcome))
                if code != EV_CLEARED and outcome != FAILED:
                    self.last = int(ts[i])
            self.prev = int(st[i])
            i += 1
            if i < n and (self.last is None or ts[i] - self.last >= self.gate_us):   # open: on to the next row that can fire
                k = int(np.searchsorted(busy, i))
                j = int(busy[k]) if k < len(busy) else n
                if j > i:
                    self.prev, i = int(st[j - 1]), j
        return out


def _fold(gate_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[S.KEY]
            fresh = (keys != keys.shift()).any(axis=1).to_numpy()
            fresh[0] = tuple(keys.iloc[0]) != key
            edges = sorted({0, *np.flatnonzero(fresh).tolist(), len(pdf)})
            ts, st, bucket = (pdf[c].to_numpy(np.int64) for c in ("ts_us", "st", "bucket"))
            flags = [pdf[c].to_numpy(bool) for c in ("e4", "e5", "lookup_failed", "publish_failed")]
            rows, codes, outcomes = [], [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if fresh[a]:
                    key, fold = tuple(keys.iloc[a]), AttemptFold(gate_us)
                e4, e5, lookup, publish = (f[a:b] for f in flags)
                change = transition_code(np.r_[fold.prev, st[a:b - 1]], st[a:b])
                for i, code, outcome in fold.run(ts[a:b], st[a:b], change, e4, e5, bucket[a:b], lookup, publish):
                    rows.append(a + i)
                    codes.append(code)
                    outcomes.append(outcome)
            if rows:
                yield pdf.iloc[rows][[*S.KEY, "ts_us", "tie"]].assign(ev=np.asarray(codes, np.int32), outcome=outcomes)
    return run


def publish_attempts(evaluated: DataFrame, th: Thresholds, *, publish_failed: Column, lookup_failed: Column) -> DataFrame:
    """KEY, ts_us, tie, event_type, severity, outcome of every attempt.  The two
    conditions say, per evaluated row, which operations failed then."""
    narrow = _narrow_of(evaluated.withColumn("_p", F.coalesce(publish_failed, F.lit(False)))
                        .withColumn("_l", F.coalesce(lookup_failed, F.lit(False))), th,
                        F.col("_p").alias("publish_failed"), F.col("_l").alias("lookup_failed"))
    narrow = narrow.withColumn("bucket", truncate_from_year_one_s(F.col("ts_us"), th.dedup_s).cast("long"))
    folded = (narrow.select(*S.KEY, "ts_us", "tie", "st", "e4", "e5", "bucket", "publish_failed", "lookup_failed").repartition(*S.KEY)
              .sortWithinPartitions(*S.KEY, "ts_us", "tie").mapInPandas(_fold(int(round(th.gate_s * 1_000_000))), _OUT))
    return _typed(folded, "outcome")
