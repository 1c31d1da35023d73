"""Gate fold for hot keys, parallel over time segments (exact).

The suppression gate is a sequential fold with state (previous status,
last gate-setting event time).  A key holding a large share of all rows
would run it in one task, so hot keys are cut into time segments:

Pass 1 (per segment, streamed in bounded memory).  The entry state of a
segment is unknown, but it matters in two ways only: which row r0 is the
first one that is not gated, and whether that row sets the gate.  The last
event happened before the segment starts, so r0 is one of the rows within
`gate` of the segment's first row, or the first row after that.  For each
such row the summary holds the segment's final state in both cases.

Pass 2 (per key, on the summary only, streamed in segment order).  Walks the
segments with the true state, from the key's carried state if there is one,
and gives each segment its entry state, and the key its final one.

Pass 3 folds every segment from its entry state, like any other key.

Cost: two folds of the rows, and (rows in the first gate window + 1) summary
rows per segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import written
from .gate_runs import NEVER, NONE, GateRuns, key_at, starts_of
from .skew import resolve

SEED, FINAL, COLD = -1, -2, -3  # in place of a segment number
SEG_KEY = [*S.KEY, "seg"]
_KEY_TYPES = "cluster string, group_id string, topic string, partition int, seg long"
SUMMARY = (f"{_KEY_TYPES}, cand long, ts_us long, st int, e4 boolean, gate_us long, "
           "fired_prev int, fired_last long, quiet_prev int, quiet_last long")
STATES = f"{_KEY_TYPES}, prev_st int, last_us long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1 over rows sorted by (KEY, seg, ts_us, tie)."""
    from .incidents import transition_code
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    held = None  # the segment that may go on: one of its rows, first time, whether r0 may still come, its candidates

    def out(row, at, cand):
        keys = [row.column(k).take(pa.array(at, pa.int64())) for k in SEG_KEY]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cand, types)]], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        col = lambda c, t: batch.column(c).fill_null(t(0)).to_numpy(zero_copy_only=False).astype(t)
        ts, st, e4, e5, gate = (col(c, t) for c, t in (("ts_us", int), ("st", int), ("e4", bool), ("e5", bool), ("gate_us", int)))
        starts = np.flatnonzero(starts_of(batch, SEG_KEY))
        runs = GateRuns(starts, ts, st, e4, e5, gate[starts], transition_code)
        tails = runs.last_on_chain()
        goes_on = held is not None and key_at(held[0], SEG_KEY, 0) == key_at(batch, SEG_KEY, 0)
        if held is not None and not goes_on:
            yield out(held[0], np.zeros(len(held[3][0])), held[3])
        first_ts, more = ts[starts].copy(), np.ones(len(starts), bool)
        number = np.zeros(len(starts), np.int64)  # candidates of the run's segment so far
        if goes_on:
            first_ts[0], more[0], number[0] = held[1], held[2], len(held[3][0])
        limit = runs.first_from(np.arange(len(starts)), first_ts + runs.gate)
        size = np.where(more, np.minimum(limit + 1, runs.ends) - starts, 0)
        run = np.repeat(np.arange(len(starts)), size)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        rows = starts[run] + nth
        fired, quiet = runs.after_row(rows, tails)
        cand = [number[run] + nth, ts[rows], st[rows], e4[rows], gate[rows], *fired, *quiet]
        if goes_on:
            old, zero = held[3], np.zeros(len(held[3][0]), np.int64)
            old = [*old[:5], *runs.through(zero, old[5], old[6], tails), *runs.through(zero, old[7], old[8], tails)]
            cand = [np.r_[a, b] for a, b in zip(old, cand)]
            run = np.r_[zero, run]
        final = run == len(starts) - 1
        if not final.all():
            yield out(batch, starts[run[~final]], [c[~final] for c in cand])
        held = (batch.slice(batch.num_rows - 1, 1), int(first_ts[-1]), bool(more[-1] and limit[-1] >= runs.ends[-1]),
                [c[final] for c in cand])
    if held is not None:
        yield out(held[0], np.zeros(len(held[3][0])), held[3])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 2 over the summary sorted by (KEY, seg, cand), a carried state as segment SEED."""
    from .incidents import transition_code
    names = [c.split()[0] for c in STATES.split(", ")]
    key, key_row, prev, last = None, None, NONE, NEVER
    done = True  # whether the segment has found its first evaluated row

    def out(row, at, seg, prevs, lasts):
        prevs, lasts = np.asarray(prevs, np.int64), np.asarray(lasts, np.int64)
        return pa.RecordBatch.from_arrays(
            [*[row.column(k).take(pa.array(at, pa.int64())) for k in S.KEY], pa.array(seg, pa.int64()),
             pa.array(prevs, pa.int32(), mask=prevs == NONE), pa.array(lasts, pa.int64(), mask=lasts == NEVER)], names=names)

    seg_now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new_key, new_seg = starts_of(batch, S.KEY).tolist(), starts_of(batch, SEG_KEY).tolist()
        new_key[0] = key is None or key_at(batch, S.KEY, 0) != key
        new_seg[0] = new_key[0] or batch.column("seg")[0].as_py() != seg_now
        cols = [batch.column(c).to_pylist() for c in ("seg", "ts_us", "st", "e4", "gate_us", "fired_prev", "fired_last", "quiet_prev", "quiet_last")]
        # codes of all possible changes to the row's status, by previous status
        changes = {p: (transition_code(np.full(batch.num_rows, p), np.array([NONE if s is None else s for s in cols[2]])) != 0).tolist()
                   for p in [NONE, -1, *S.STATUS_CODES.values()]}
        at, segs, prevs, lasts = [], [], [], []
        for i, (seg, ts, _, e4, gate, fp, fl, qp, ql) in enumerate(zip(*cols)):
            if new_key[i]:
                if key is not None:
                    at.append(i - 1) if i else None
                    if i:
                        segs.append(FINAL), prevs.append(prev), lasts.append(last)
                    else:
                        yield out(key_row, [0], [FINAL], [prev], [last])
                key, prev, last = True, NONE, NEVER
            if seg == SEED:
                prev, last = NONE if fp is None else fp, NEVER if fl is None else fl
                continue
            if new_seg[i]:
                done = False
                at.append(i), segs.append(seg), prevs.append(prev), lasts.append(last)
            if not done and (last == NEVER or ts - last >= gate):
                done = True
                if e4 or changes[prev][i]:
                    prev, last = fp, fl
                else:
                    prev, last = qp, last if ql == NEVER else ql
        if at:
            yield out(batch, at, segs, prevs, lasts)
        key, key_row, seg_now = key_at(batch, S.KEY, batch.num_rows - 1), batch.slice(batch.num_rows - 1, 1), cols[0][-1]
    if key is not None:
        yield out(key_row, [0], [FINAL], [prev], [last])


def fold_gate_split(narrow: DataFrame, hot_key_rows: int | str, state: DataFrame | None = None,
                    emit_state: bool = False) -> DataFrame:
    """narrow (KEY, ts_us, tie, st, e4, e5, gate_us) -> FOLD_OUT, exact.

    Keys at or under the threshold are folded in one piece; only keys above
    it go through passes 1 and 2.  `state` and `emit_state` as in `fold_gate`."""
    from .incidents import FOLD_OUT, STATE_EV, fold_sorted, fold_stream, with_seeds
    if hasattr(hot_key_rows, "table"):
        if hot_key_rows.table is None:
            return fold_sorted(narrow, state, emit_state)
    narrow = written(narrow, f"gate-{uuid4().hex}")  # read by the hot-key decision and by passes 1 and 3
    hot = resolve(narrow, hot_key_rows)
    if hot is None:
        return fold_sorted(narrow, state, emit_state)
    frac = (F.col("ts_us") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1).cast("double")
    seg = F.when(F.col("_nseg").isNull(), F.lit(COLD)).otherwise(F.least(F.floor(frac * F.col("_nseg")), F.col("_nseg") - 1))
    rows = narrow.join(hot, S.KEY, "left").withColumn("seg", seg.cast("long")).drop("_nseg", "_lo", "_hi")
    cut = rows.filter(F.col("seg") != COLD)
    summary = (cut.select(*SEG_KEY, "ts_us", "tie", "st", "e4", "e5", "gate_us").repartition(*SEG_KEY)
               .sortWithinPartitions(*SEG_KEY, "ts_us", "tie").mapInArrow(_summaries, SUMMARY))
    hot_keys = hot.select(*S.KEY)
    seeds = None
    if state is not None:
        known = state.join(hot_keys, S.KEY, "left_semi").select(
            *S.KEY, F.lit(SEED).cast("long").alias("seg"), F.col("prev_st").cast("int").alias("fired_prev"),
            F.col("last_us").cast("long").alias("fired_last"))
        summary = summary.unionByName(known, allowMissingColumns=True)
        seeds = state.join(hot_keys, S.KEY, "left_anti").select(*S.KEY, F.lit(COLD).cast("long").alias("seg"), "prev_st", "last_us")
    walked = written(summary.repartition(*S.KEY).sortWithinPartitions(*S.KEY, "seg", "cand").mapInArrow(_walk, STATES),
                     f"gate-{uuid4().hex}")
    entries = walked.filter(F.col("seg") != FINAL)
    seeds = entries if seeds is None else entries.unionByName(seeds)
    out = T.StructType([*FOLD_OUT.fields[:4], T.StructField("seg", T.LongType()), *FOLD_OUT.fields[4:]])
    folded = (with_seeds(rows, seeds, "seg").repartition(*SEG_KEY).sortWithinPartitions(*SEG_KEY, "ts_us", "tie")
              .mapInArrow(fold_stream(SEG_KEY, emit_state), out))
    if not emit_state:
        return folded.select(*FOLD_OUT.fieldNames())
    ends = walked.filter(F.col("seg") == FINAL).select(
        *S.KEY, F.col("last_us").alias("ts_us"), F.lit(0).alias("tie"), F.lit(STATE_EV).alias("ev"), "prev_st", "last_us")
    return (folded.filter((F.col("ev") != STATE_EV) | (F.col("seg") == COLD)).select(*FOLD_OUT.fieldNames())
            .unionByName(ends))
