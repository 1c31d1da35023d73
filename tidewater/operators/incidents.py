"""Incident events from evaluated rows.

Per key and in time order, an evaluation either is *gated* (less than
`gate_s` after the key's last gate-setting event: nothing happens, and the
previous status stays frozen) or it compares its status with the previous
one (E1/E3), checks rapid lag growth (E4) and lag cleared (E5), then records
its status as the previous one.  E3 and E4 set the gate; E5 does not.

The gate is a sequential fold whose state is (previous status, last event
time).  It runs as one sorted stream per key:

    narrow projection -> row_number over (KEY, ts, tie) -> mapInArrow(fold)

The window asks for rows dealt by KEY and sorted, so evaluated rows, which are
dealt by KEY already, are not shuffled again.

Memory is bounded by an Arrow batch: state is carried across batches, so a
key with a very long history is streamed, never materialised as one group
(no applyInPandas, no collect_list of a key's history).  Inside a batch all
keys are folded together with array operations (see gate_runs), and the key
columns stay in Arrow.  Conditions E4/E5 and the status codes are computed in the
JVM before the Python step.  The event payload either goes through the fold
beside them (`payload`), so that the evaluation is read once and never joined,
or is joined back afterwards, as where hot keys are cut into segments.  The
gate length is a column too, so clusters with different settings share one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..config import Thresholds
from ..functions import text as X
from ..functions.codes import status_code
from ..functions.timefn import from_epoch_us, truncate_from_year_one_s
from .evaluate import KIND_WINDOW, message_text
from .gate_runs import EV_CLEARED, EV_RAPID, EV_RECOVERED, EV_STALLED, EV_STOPPED, NEVER, NONE, GateRuns, key_at, starts_of
from .skew import HotKeys

EVENT_OF_CODE = {
    EV_STOPPED: (S.CONSUMER_STOPPED, S.SEV_CRITICAL),
    EV_STALLED: (S.CONSUMER_STALLED, S.SEV_WARNING),
    EV_RECOVERED: (S.CONSUMER_RECOVERED, S.SEV_INFO),
    EV_RAPID: (S.RAPID_LAG_INCREASE, S.SEV_WARNING),
    EV_CLEARED: (S.LAG_CLEARED, S.SEV_INFO),
}

_A, _L, _ST, _SP, _E = (S.STATUS_CODES[x] for x in (S.ACTIVE, S.LAGGING, S.STALLED, S.STOPPED, S.EMPTY))

FOLD_OUT = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("cluster", "group_id", "topic")],
    T.StructField("partition", T.IntegerType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("tie", T.IntegerType()),
    T.StructField("ev", T.IntegerType()),
    T.StructField("prev_st", T.IntegerType()),
    T.StructField("last_us", T.LongType()),
])
#: what an event record takes from its evaluated row
PAYLOAD = ["current_lag", "current_offset", "high_watermark", "consumption_rate", "lag_change_rate",
           "time_since_last_move_s", "window_completeness", "n_records", "health", "status", "lag_trend",
           "is_active", "message"]
STATE_EV = 0  # output rows with ev = 0 carry a key's final gate state


def transition_code(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """E3 as a vectorised table lookup: 0 = no event."""
    out = np.zeros(len(cur), dtype=np.int32)
    out[(cur == _SP) & ((prev == _A) | (prev == _L))] = EV_STOPPED
    out[(cur == _ST) & (prev == _A)] = EV_STALLED
    out[((cur == _A) | (cur == _E)) & ((prev == _SP) | (prev == _ST))] = EV_RECOVERED
    return out


class GateFold:
    """The state of one key (previous status, last gate-setting event time)."""

    NONE = NONE

    def __init__(self, gate_us: int):
        self.gate_us, self.prev, self.last = gate_us, NONE, None

    def run_key(self, ts: np.ndarray, st: np.ndarray, e4: np.ndarray, e5: np.ndarray):
        """Fold the key's next rows; returns (row index, event code) arrays."""
        runs = GateRuns(np.zeros(1, np.int64), ts, st, e4, e5, np.array([self.gate_us]), transition_code)
        rows, codes, prev, last = runs.fold(np.array([self.prev]), np.array([NEVER if self.last is None else self.last]))
        self.prev, self.last = int(prev[0]), None if last[0] == NEVER else int(last[0])
        return rows, codes


def fold_stream(keys: list[str], emit_state: bool, payload: tuple[str, ...] = ()):
    """mapInArrow function: the fold over rows sorted by (`keys`, ts_us, tie), a
    seed row of carried state before its key's rows.  Events keep their row's
    `payload` columns."""
    names = [*keys, *[f.name for f in FOLD_OUT.fields if f.name not in keys], *payload]

    def rows_of(batch, at, ts, tie, ev, prev=None, last=None):
        cols = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
        none = lambda t: pa.nulls(len(at), t)
        more = [batch.column(c).take(pa.array(at, pa.int64())) if prev is None else none(batch.column(c).type) for c in payload]
        return pa.RecordBatch.from_arrays(
            [*cols, ts, tie, pa.array(ev, pa.int32()), none(pa.int32()) if prev is None else prev,
             none(pa.int64()) if last is None else last, *more], names=names)

    def states(batch, at, prev, last):
        at, prev, last = np.asarray(at, np.int64), np.asarray(prev, np.int64), np.asarray(last, np.int64)
        when = pa.array(last, pa.int64(), mask=last == NEVER)
        return rows_of(batch, at, when, pa.array(np.zeros(len(at)), pa.int32()), np.full(len(at), STATE_EV),
                       pa.array(prev, pa.int32(), mask=prev == NONE), when)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (batch of one row, prev, last) of the key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = starts_of(batch, keys)
            goes_on = held is not None and key_at(held[0], keys, 0) == key_at(batch, keys, 0)
            if held is not None and not goes_on and emit_state:
                yield states(held[0], [0], [held[1]], [held[2]])
            col = lambda c, t: batch.column(c).fill_null(t(0)).to_numpy(zero_copy_only=False).astype(t)
            seed = col("is_seed", bool)
            first = np.flatnonzero(new)
            prev, last = np.full(len(first), NONE), np.full(len(first), NEVER)
            if goes_on:
                prev[0], last[0] = held[1], held[2]
            own = np.cumsum(new) - 1  # each row's key, as a number in this batch
            at = np.flatnonzero(seed)
            for name, target, missing in (("seed_prev", prev, NONE), ("seed_last", last, NEVER)):
                target[own[at]] = batch.column(name).fill_null(missing).to_numpy(zero_copy_only=False)[at]
            rows = np.flatnonzero(~seed)
            if len(rows):
                starts = np.flatnonzero(np.r_[True, np.diff(own[rows]) != 0])
                of = own[rows[starts]]
                runs = GateRuns(starts, *(col(c, t)[rows] for c, t in (("ts_us", int), ("st", int), ("e4", bool), ("e5", bool))),
                                col("gate_us", int)[rows[starts]], transition_code)
                hits, codes, prev[of], last[of] = runs.fold(prev[of], last[of])
                if len(hits):
                    at = pa.array(rows[hits], pa.int64())
                    yield rows_of(batch, rows[hits], batch.column("ts_us").take(at), batch.column("tie").take(at), codes)
            if emit_state and len(first) > 1:
                yield states(batch, first[:-1], prev[:-1], last[:-1])
            held = batch.slice(batch.num_rows - 1, 1), int(prev[-1]), int(last[-1])
        if held is not None and emit_state:
            yield states(held[0], [0], [held[1]], [held[2]])
    return fn


def with_tie(rows: DataFrame) -> DataFrame:
    """Rows written without `tie` hold one row per key, kind and time."""
    return rows if "tie" in rows.columns else rows.withColumn("tie", F.lit(0))


def _narrow(evaluated: DataFrame, rapid: Column, floor: Column, gate_us: Column, *more: Column) -> DataFrame:
    w = with_tie(evaluated).filter(F.col("kind") == KIND_WINDOW)
    return w.select(
        *S.KEY, "ts_us", "tie", status_code("status").alias("st"),
        ((F.col("lag_change_rate") > rapid * 2) & (F.col("current_lag") > floor)).alias("e4"),
        ((F.col("current_lag") == 0) & (F.col("n_records") > 2)
         & F.coalesce(F.col("prev_lag") > floor, F.lit(False))).alias("e5"),
        gate_us.alias("gate_us"), *more)


def _narrow_of(evaluated: DataFrame, th: Thresholds | DataFrame, *more: Column) -> DataFrame:
    if isinstance(th, Thresholds):
        return _narrow(evaluated, F.lit(float(th.rapid_rate)), F.lit(th.lag_floor),
                       F.lit(int(round(th.gate_s * 1_000_000))).cast("long"), *more)
    own = th.select("cluster", F.col("rapid_rate").alias("_rapid"), F.col("lag_floor").alias("_floor"),
                    F.round(F.col("gate_s") * 1_000_000).cast("long").alias("_gate"))
    return _narrow(evaluated.join(F.broadcast(own), "cluster"), F.col("_rapid"), F.col("_floor"), F.col("_gate"), *more)


def with_seeds(narrow: DataFrame, state: DataFrame | None, *more: str, payload: tuple[str, ...] = ()) -> DataFrame:
    """Rows for `fold_stream`; `state` (KEY, `more`, prev_st, last_us) comes before its key's rows."""
    rows = narrow.select(*S.KEY, *more, "ts_us", "tie", "st", "e4", "e5", "gate_us", F.lit(False).alias("is_seed"),
                         F.lit(None).cast("int").alias("seed_prev"), F.lit(None).cast("long").alias("seed_last"), *payload)
    if state is None:
        return rows
    return rows.unionByName(state.select(
        *S.KEY, *more, F.lit(NEVER).cast("long").alias("ts_us"), F.lit(0).alias("tie"),
        F.lit(-1).alias("st"), F.lit(False).alias("e4"), F.lit(False).alias("e5"),
        F.lit(0).cast("long").alias("gate_us"), F.lit(True).alias("is_seed"),
        F.col("prev_st").cast("int").alias("seed_prev"), F.col("last_us").cast("long").alias("seed_last")), allowMissingColumns=True)


def fold_sorted(narrow: DataFrame, state: DataFrame | None = None, emit_state: bool = False,
                payload: tuple[str, ...] = ()) -> DataFrame:
    """The fold as one sorted stream per key (see the module's text)."""
    rows = with_seeds(narrow, state, payload=payload)
    out = T.StructType([*FOLD_OUT.fields, *[narrow.schema[c] for c in payload]])
    in_order = Window.partitionBy(*S.KEY).orderBy("ts_us", "tie")
    return rows.withColumn("_place", F.row_number().over(in_order)).mapInArrow(fold_stream(S.KEY, emit_state, payload), out)


def splits(hot_key_rows: int | str | HotKeys | None) -> bool:
    """Whether a fold with this setting may cut keys into segments."""
    return hot_key_rows.table is not None if isinstance(hot_key_rows, HotKeys) else bool(hot_key_rows)


def fold_gate(evaluated: DataFrame, th: Thresholds | DataFrame, state: DataFrame | None = None,
              emit_state: bool = False, hot_key_rows: int | str | HotKeys | None = None, payload: bool = False) -> DataFrame:
    """Run the gate fold; `state` (KEY, prev_st, last_us) seeds keys that
    were folded before (a stream's previous micro-batches).  Output rows
    with ev > 0 are events; with `emit_state`, one row per key with ev = 0
    carries its final (prev_st, last_us).  With `hot_key_rows`, keys above
    that many rows are folded in parallel time segments and stitched exactly,
    from and to the same kind of state (see gate_split); once a gate has run
    out, `last_us` may name another time for which that holds too.  With
    `payload`, the columns of PAYLOAD come along where keys are not split."""
    if payload and not splits(hot_key_rows):
        return fold_sorted(_narrow_of(evaluated, th, *PAYLOAD), state, emit_state, tuple(PAYLOAD))
    narrow = _narrow_of(evaluated, th)
    if not hot_key_rows:
        return fold_sorted(narrow, state, emit_state)
    from .gate_split import fold_gate_split
    return fold_gate_split(narrow, hot_key_rows, state, emit_state)


def _typed(folded: DataFrame, *more: str) -> DataFrame:
    types = F.create_map(*[x for code, (t, _) in EVENT_OF_CODE.items() for x in (F.lit(code), F.lit(t))])
    sev = F.create_map(*[x for code, (_, s) in EVENT_OF_CODE.items() for x in (F.lit(code), F.lit(s))])
    return folded.filter(F.col("ev") > 0).select(
        *S.KEY, "ts_us", "tie", "ev", types[F.col("ev")].alias("event_type"), sev[F.col("ev")].alias("severity"), *more)


def detect(evaluated: DataFrame, th: Thresholds | DataFrame, hot_key_rows: int | str | HotKeys | None = None,
           payload: bool = False) -> DataFrame:
    """Gated event candidates (KEY, ts_us, tie, event_type, severity).

    `th` is one set of thresholds or a table with one row per cluster (S4):
    each cluster's rate and lag limits and gate length then come by a join,
    and all clusters go through one fold.

    With `hot_key_rows`, keys above that many rows are folded in parallel
    time segments and stitched exactly (see gate_split).  With `payload`,
    events bring the columns of PAYLOAD with them where keys are not split, and
    `event_records` needs no join."""
    folded = fold_gate(evaluated, th, hot_key_rows=hot_key_rows, payload=payload)
    return _typed(folded, *[c for c in PAYLOAD if c in folded.columns])


def detect_with_state(evaluated: DataFrame, th: Thresholds, state: DataFrame | None,
                      hot_key_rows: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Streaming form: (events, new state).  The fold output should be
    persisted/written once by the caller since both results derive from it."""
    folded = fold_gate(evaluated, th, state, emit_state=True, hot_key_rows=hot_key_rows)
    new_state = folded.filter(F.col("ev") == STATE_EV).select(*S.KEY, "prev_st", "last_us")
    return _typed(folded), new_state


def event_records(evaluated: DataFrame, detected: DataFrame, th: Thresholds | DataFrame, *,
                  source: str = S.DEFAULT_EVENT_SOURCE, deterministic_ids: bool = True,
                  fingerprint_with_cluster: bool = False) -> DataFrame:
    """E6 + X5-X7: full event rows.  The payload comes from the evaluated
    row of the same (KEY, ts_us, tie): either the events have brought it with
    them, or it is joined; the join lets AQE broadcast the (small) detected side
    when its runtime size allows and sort-merge otherwise.  Messages (W11) that
    the evaluation has left out are made here, for the events only."""
    j = with_tie(detected)
    if not set(PAYLOAD) <= set(j.columns):
        payload = with_tie(evaluated).filter(F.col("kind") == KIND_WINDOW).select(*S.KEY, "ts_us", "tie", *PAYLOAD)
        j = j.join(payload, S.KEY + ["ts_us", "tie"], "inner")
    j = j.withColumn("kind", F.lit(KIND_WINDOW))
    if isinstance(th, Thresholds):
        rapid_rate, dedup_s, min_size = F.lit(th.rapid_rate), th.dedup_s, F.lit(th.min_size)
    else:
        j = j.join(F.broadcast(th.select("cluster", F.col("rapid_rate").alias("_rapid"), F.col("dedup_s").alias("_dedup"),
                                         F.col("min_size").alias("_min"))), "cluster")
        rapid_rate, dedup_s, min_size = F.col("_rapid"), F.col("_dedup"), F.col("_min")
    et = F.col("event_type")
    desc = (F.when(et == S.RAPID_LAG_INCREASE,
                   F.format_string(X.MSG_RAPID, F.col("lag_change_rate"), rapid_rate))
            .when(et == S.LAG_CLEARED, F.lit(X.MSG_CLEARED))
            .otherwise(F.coalesce(F.col("message"), message_text(min_size))))
    bucket = truncate_from_year_one_s(F.col("ts_us"), dedup_s)
    fp_parts = [F.lit(source), et, F.col("group_id"), F.col("topic"), F.col("partition").cast("string"),
                bucket.cast("string")]
    if fingerprint_with_cluster:
        fp_parts.insert(1, F.col("cluster"))
    fingerprint = F.md5(F.concat_ws(":", *fp_parts))
    j = j.withColumn("fingerprint", fingerprint)
    ev_id = (F.md5(F.concat_ws("|", F.col("fingerprint"), F.col("ts_us").cast("string"), F.col("cluster")))
             if deterministic_ids else F.expr("uuid()"))
    us = (F.col("time_since_last_move_s") * 1_000_000).cast("long")
    return j.select(
        ev_id.alias("id"), F.lit(source).alias("source"), et.alias("type"), "severity",
        from_epoch_us("ts_us").alias("timestamp"), "ts_us", "cluster",
        F.format_string(X.TITLE, et, F.col("group_id")).alias("title"), desc.alias("description"),
        F.create_map(
            F.lit("window_completeness"), F.col("window_completeness").cast("string"),
            F.lit("health"), F.col("health"), F.lit("status"), F.col("status"),
            F.lit("lag_trend"), F.col("lag_trend"),
            F.lit("is_active"), F.col("is_active").cast("string")).alias("data"),
        "fingerprint", F.col("group_id").alias("consumer_group"), "group_id", "topic", "partition",
        "current_lag", "current_offset", "high_watermark",
        F.lit(0).cast("long").alias("lag_delta"), F.lit(0).cast("long").alias("offset_delta"),
        "consumption_rate", "lag_change_rate", X.duration_text_us(us).alias("time_since_last_move"),
        bucket.alias("dedup_bucket_s"))


def dedup(events: DataFrame) -> DataFrame:
    """First event per fingerprint wins (earliest time, then cluster,
    then id).  `min_by` over a struct plans as a sort aggregate with map-side
    partial aggregation; a fingerprint group is bounded by one key's events
    in one dedup bucket."""
    cols = [c for c in events.columns if c != "fingerprint"]
    order = F.struct("ts_us", "cluster", "id")
    return (events.groupBy("fingerprint")
            .agg(F.min_by(F.struct(*cols), order).alias("_e"))
            .select("_e.*", "fingerprint").select(*events.columns))


def incidents(evaluated: DataFrame, th: Thresholds, *, enabled: bool = True, **kw) -> DataFrame:
    """E1-E8 end to end: detected -> records -> de-duplicated.  A disabled
    publisher produces no events and keeps no gate state (E8)."""
    if not enabled:
        return event_records(evaluated, detect(evaluated, th).limit(0), th, **kw)
    return dedup(event_records(evaluated, detect(evaluated, th, payload=True), th, **kw))
