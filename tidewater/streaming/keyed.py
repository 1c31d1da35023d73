"""Keyed streaming state (ST2, ST3, ST5, P6, S10) with transformWithState.

Two streaming queries, each with state of its own in RocksDB, keyed by KEY:

* `windows`: samples -> per key the last N - 1 windowed records and the time of
  its newest row, as one value.  A key that gets rows in a micro-batch puts out
  its old tail and the new rows, which the batch operator evaluates.
* `gate`: status rows -> per key the previous status and the last event.

Reads and writes of state follow the keys that a micro-batch touches, never
all live keys.  Rows not newer than their key's newest row are late: they
change nothing, so a batch that is delivered again has no effect.

Time to live.  A key silent for longer than `ttl_s` starts afresh: window and
previous status are forgotten when its next row comes (so results depend on
the rows alone, not on the cut into micro-batches), and an event-time timer
frees the state once the watermark has passed.  A row of kind REMOVED drops a
key at once, for keys that leave the active set.

A stream can start from saved state: `initial` tables seed both queries;
snapshots older than the time to live are refused, and records that cannot be
read are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..config import Thresholds
from ..functions.codes import status_code
from ..functions.timefn import epoch_us
from ..operators.evaluate import KIND_WINDOW, STATUS_COLUMNS, evaluate
from ..operators.gate_runs import NEVER, NONE, GateRuns
from ..operators.incidents import STATE_EV, _typed, event_records, transition_code
from ..session import ship_package
from ..sources.positions import lag_of
from .snapshots import tail_rows

NEW, TAIL, LATE = "new", "tail", "late"
REMOVED = "removed"
_KEY_TYPES = "cluster string, group_id string, topic string, partition int"
_RECORD = ["ts_us", "committed_offset", "high_watermark", "lag"]
_RECORD_TYPES = "ts_us long, committed_offset long, high_watermark long, lag long"
ROLE_ROWS = f"{_KEY_TYPES}, {_RECORD_TYPES}, session_us long, role string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONG_AGO = NEVER


def _joined(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _longs(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, null mask) of a column of whole numbers."""
    null = col.isna().to_numpy()
    return (np.where(null, 0, col.to_numpy()) if null.any() else col.to_numpy()).astype(np.int64), null


def _output(key: tuple, n: int, columns: dict) -> pd.DataFrame:
    """`n` rows behind the key's columns; a pair is (whole numbers, null mask)."""
    own = {name: np.full(n, key[i], object) for i, name in enumerate(S.KEY)}
    return pd.DataFrame({**own, **{c: pd.arrays.IntegerArray(*v) if isinstance(v, tuple) else v for c, v in columns.items()}}, copy=False)


def sessions(ts: np.ndarray, seen: int, start: int, ttl_us: int | None) -> np.ndarray:
    """For sorted times of a key, the first time of the stretch each row
    belongs to; a gap above the time to live begins a new one."""
    out = np.full(len(ts), start, np.int64)
    if not len(ts):
        return out
    fresh = np.diff(np.r_[seen, ts]) > ttl_us if ttl_us is not None else np.zeros(len(ts), bool)
    if seen == _LONG_AGO:
        fresh[0] = True
    at = np.where(fresh, np.arange(len(ts)), -1)
    at = np.maximum.accumulate(at)
    out[at >= 0] = ts[at[at >= 0]]
    return out


class _Timed(StatefulProcessor):
    """One event-time timer per key, `ttl_us` after its newest row."""

    def __init__(self, ttl_us: int | None):
        self.ttl_us = ttl_us

    def _set_timer(self, old_us: int, new_us: int) -> None:
        if self.ttl_us is None:
            return
        due = lambda us: (us + self.ttl_us) // 1000 + 1
        if old_us != _LONG_AGO and due(old_us) != due(new_us):
            self.handle.deleteTimer(due(old_us))
        self.handle.registerTimer(due(new_us))


class WindowTail(_Timed):
    def __init__(self, n: int, ttl_us: int | None):
        super().__init__(ttl_us)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one state per key: newest time, start of its stretch, tail as flat records
        self.at = handle.getValueState("at", "seen_us long, session_us long, tail array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _joined(rows)
        (ts, _), (off, no_off), (hwm, no_hwm), (lag, no_lag) = (_longs(pdf[c]) for c in _RECORD)
        removed = (pdf["kind"] == REMOVED).to_numpy(bool)
        order = np.lexsort((hwm, no_hwm, off, no_off, ts))  # nulls last
        ts, removed = ts[order], removed[order]
        values = [off[order], hwm[order], lag[order]]
        nulls = [no_off[order], no_hwm[order], no_lag[order]]
        was = self.at.get()
        seen, start, tail = (_LONG_AGO, _LONG_AGO, []) if was is None else was
        gone = np.flatnonzero(ts <= seen)
        new = np.flatnonzero((ts > seen) & ~removed)
        late_start = start
        if removed.any():
            cut = int(ts[removed].max())
            if cut >= seen:
                self._forget(seen)
                seen, start, tail = _LONG_AGO, _LONG_AGO, []
        at, old = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        if len(new):
            at = sessions(ts[new], seen, start, self.ttl_us)
            tail = np.asarray(tail, np.int64).reshape(-1, 4)
            if at[0] == start:
                old = tail
            last = new[(at == at[-1]) & ~nulls[0][new] & ~nulls[1][new]]
            records = np.column_stack([ts[last], *[v[last] for v in values]])
            keep = np.r_[old if at[-1] == start else old[:0], records][-self.n:] if self.n else old[:0]
            newest = int(ts[new[-1]])
            self._set_timer(seen, newest)
            self.at.update((newest, int(at[-1]), keep.ravel().tolist()))
        n = len(gone) + len(old) + len(new)
        if n:
            none = np.zeros(len(old), bool)
            whole = {c: (np.r_[v[gone], old[:, i + 1], v[new]], np.r_[m[gone], none, m[new]])
                     for i, (c, v, m) in enumerate(zip(_RECORD[1:], values, nulls))}
            yield _output(key, n, {
                "ts_us": np.r_[ts[gone], old[:, 0], ts[new]], **whole,
                "session_us": np.r_[np.full(len(gone), late_start), np.full(len(old), start), at],
                "role": np.repeat(np.array([LATE, TAIL, NEW], object), [len(gone), len(old), len(new)])})

    def _forget(self, seen: int) -> None:
        if self.ttl_us is not None and seen != _LONG_AGO:
            self.handle.deleteTimer((seen + self.ttl_us) // 1000 + 1)
        self.at.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        records = [int(r[c]) for r in row["records"][-self.n:] for c in _RECORD] if self.n else []
        seen = int(row["seen_us"])
        self.at.update((seen, int(row["session_us"]), records))
        self._set_timer(_LONG_AGO, seen)


GATE_ROWS = ("ts_us long, tie int, ts timestamp_ntz, kind string, current_offset long, high_watermark long, current_lag long, n_records int, "
             "window_completeness double, consumption_rate double, lag_change_rate double, is_active boolean, "
             "time_since_last_move_s double, lag_trend string, status string, health string, prev_lag long, message string")
_GATE_NAMES = [c.split()[0] for c in GATE_ROWS.split(", ")]
_GATE_WHOLE = {c.split()[0] for c in GATE_ROWS.split(", ") if c.split()[1] in ("int", "long")}
GATE_OUT = f"{_KEY_TYPES}, ev int, prev_st int, last_us long, {GATE_ROWS}"


class Gate(_Timed):
    """E1-E5 with the suppression gate; one state row per touched key (ev = 0)."""

    def __init__(self, gate_us: int, ttl_us: int | None):
        super().__init__(ttl_us)
        self.gate_us = gate_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "prev_st int, last_us long, seen_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _joined(rows)
        was = self.state.get()
        prev, last, seen = (NONE, _LONG_AGO, _LONG_AGO) if was is None else was
        ts, tie = (_longs(pdf[c])[0] for c in ("ts_us", "tie"))
        order = np.lexsort((tie, ts))
        order = order[ts[order] > seen]
        if not len(order):
            return
        before, ts = seen, ts[order]
        kind = pdf["kind"].to_numpy()[order]
        removed = kind == REMOVED
        start = sessions(ts, seen, seen, self.ttl_us)
        fresh = np.r_[start[0] != seen, start[1:] != start[:-1]] | np.r_[False, removed[:-1]]
        part = np.cumsum(fresh)  # 0: goes on from the state
        at = np.flatnonzero(kind == KIND_WINDOW)
        rows, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = (prev, last) if part[-1] == 0 else (NONE, NEVER)
        if len(at):
            own = part[at]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            went_on = own[first] == 0
            st, e4, e5 = (pdf[c].to_numpy()[order][at] for c in ("st", "e4", "e5"))
            runs = GateRuns(first, ts[at], st.astype(np.int64), e4.astype(bool), e5.astype(bool),
                            np.full(len(first), self.gate_us), transition_code)
            hits, codes, prevs, lasts = runs.fold(np.where(went_on, prev, NONE), np.where(went_on, last, NEVER))
            rows = at[hits]
            if own[-1] == part[-1]:
                end = int(prevs[-1]), int(lasts[-1])
        seen = int(ts[-1])
        put, code = rows, codes
        if removed[-1]:
            self._forget(before)
        else:
            self._set_timer(before, seen)
            self.state.update((*end, seen))
            put, code = np.r_[rows, len(ts) - 1], np.r_[codes, STATE_EV]  # the state row comes last
        n = len(put)
        if n:
            state = code == STATE_EV
            taken = {name: pdf[name].iloc[order[put]].reset_index(drop=True) for name in _GATE_NAMES}
            yield _output(key, n, {
                "ev": code, "prev_st": (np.full(n, end[0]), ~state),
                "last_us": (np.full(n, end[1]), ~state | (end[1] == NEVER)),
                **{c: _longs(v) if c in _GATE_WHOLE else v for c, v in taken.items()}})

    def _forget(self, seen: int) -> None:
        if self.ttl_us is not None and seen != _LONG_AGO:
            self.handle.deleteTimer((seen + self.ttl_us) // 1000 + 1)
        self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        last = row["last_us"]
        self.state.update((int(row["prev_st"]), _LONG_AGO if pd.isna(last) else int(last), int(row["seen_us"])))
        self._set_timer(_LONG_AGO, int(row["seen_us"]))


def _event_time(df: DataFrame, delay_s: float) -> DataFrame:
    return df.withColumn("_evt", F.timestamp_micros("ts_us")).withWatermark("_evt", f"{int(delay_s)} seconds")


class KeyedMonitor:
    """Runs both queries under `root`: `status/` and `late/` from the samples,
    `events/` and `gate/` (the state of touched keys) from the status rows.

    `watermark_s` is how far behind the newest row a row may come; older ones
    are dropped by the stream itself.  A restored monitor takes `windows`
    (KEY, records, seen_us, session_us) and `gates` (KEY, prev_st, last_us,
    seen_us) as made by `saved_windows` and `saved_gates`."""

    def __init__(self, spark: SparkSession, th: Thresholds, root: str, *, ttl_s: float | None = None,
                 watermark_s: float = 86_400.0, windows: DataFrame | None = None, gates: DataFrame | None = None):
        self.spark, self.th, self.root = spark, th, root.rstrip("/")
        self.ttl_us = None if ttl_s is None else int(ttl_s * 1_000_000)
        self.watermark_s, self.windows, self.gates = watermark_s, windows, gates
        self.progress: list = []
        ship_package(spark)

    def _run(self, stream: DataFrame, name: str, batch) -> None:
        conf = self.spark.conf
        old = conf.get("spark.sql.streaming.stateStore.providerClass")
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        try:
            q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/_checkpoint_{name}")
                 .trigger(availableNow=True).start())
            q.awaitTermination()
            self.progress += [(name, p) for p in q.recentProgress]
        finally:
            conf.set("spark.sql.streaming.stateStore.providerClass", old)

    def run_windows(self, samples: DataFrame) -> None:
        """All samples that have arrived (a stream with SAMPLE_SCHEMA, and `kind` REMOVED for keys that left)."""
        src = (samples.withColumn("ts_us", epoch_us("ts", samples.schema["ts"].dataType))
               .withColumn("lag", lag_of("high_watermark", "committed_offset"))
               .withColumn("kind", F.col("kind") if "kind" in samples.columns else F.lit(None).cast("string")))
        rows = _event_time(src.select(*S.KEY, *_RECORD, "kind"), self.watermark_s).groupBy(*S.KEY).transformWithStateInPandas(
            WindowTail(max(self.th.window_size - 1, 0), self.ttl_us), ROLE_ROWS, "Append", "EventTime",
            initialState=None if self.windows is None else self.windows.groupBy(*S.KEY))
        self._run(rows, "windows", self._evaluate)

    def _evaluate(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            late = rows.filter(F.col("role") == LATE).select(*S.KEY, *_RECORD)
            late.write.mode("overwrite").parquet(f"{self.root}/late/batch_id={batch_id}")
            known = rows.filter(F.col("role") != LATE).withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))
            ev = evaluate(known, self.th, within=("session_us",), passthrough=("role", "session_us"))
            (ev.filter(F.col("role") == NEW).drop("role").write.mode("overwrite")
             .parquet(f"{self.root}/status/batch_id={batch_id}"))
        finally:
            rows.unpersist()

    def run_gate(self) -> None:
        """All status rows that have been written."""
        th = self.th
        schema = self.spark.read.parquet(f"{self.root}/status").drop("batch_id").schema
        status = self.spark.readStream.schema(schema).parquet(f"{self.root}/status/*/")
        src = status.select(
            *S.KEY, *[c.split()[0] for c in GATE_ROWS.split(", ")], F.coalesce(status_code("status"), F.lit(-1)).alias("st"),
            F.coalesce((F.col("lag_change_rate") > float(th.rapid_rate) * 2) & (F.col("current_lag") > th.lag_floor), F.lit(False)).alias("e4"),
            F.coalesce((F.col("current_lag") == 0) & (F.col("n_records") > 2) & (F.col("prev_lag") > th.lag_floor), F.lit(False)).alias("e5"))
        out = _event_time(src, self.watermark_s).groupBy(*S.KEY).transformWithStateInPandas(
            Gate(int(round(th.gate_s * 1_000_000)), self.ttl_us), GATE_OUT, "Append", "EventTime",
            initialState=None if self.gates is None else self.gates.groupBy(*S.KEY))
        self._run(out, "gate", self._publish)

    def _publish(self, rows: DataFrame, batch_id: int) -> None:
        path = f"{self.root}/gate/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path)
        fired = rows.filter(F.col("ev") > 0)
        payload = fired.select(*STATUS_COLUMNS).dropDuplicates([*S.KEY, "ts_us", "tie"])
        event_records(payload, _typed(fired), self.th).write.mode("overwrite").parquet(f"{self.root}/events/batch_id={batch_id}")

    # -- results and saved state ----------------------------------------------
    def status(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/status").drop("batch_id")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/events").drop("batch_id")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/late").drop("batch_id")

    def saved_gates(self) -> DataFrame:
        """The newest gate state of every key, from what was put out for touched keys."""
        rows = self.spark.read.parquet(f"{self.root}/gate").filter(F.col("ev") == STATE_EV)
        top = rows.groupBy(*S.KEY).agg(F.max_by(F.struct("prev_st", "last_us"), "ts_us").alias("g"), F.max("ts_us").alias("seen_us"))
        return top.select(*S.KEY, "g.prev_st", "g.last_us", "seen_us")

    def saved_windows(self) -> DataFrame:
        """S9 form of every key's tail: the last records of its newest stretch."""
        st = self.status()
        newest = st.groupBy(*S.KEY).agg(F.max("ts_us").alias("seen_us"), F.max("session_us").alias("session_us"))
        own = st.join(newest.select(*S.KEY, "session_us"), [*S.KEY, "session_us"], "left_semi").filter(
            F.col("kind") == KIND_WINDOW).select(*S.KEY, "ts_us", F.col("current_offset").alias("committed_offset"),
                                                 "high_watermark", F.col("current_lag").alias("lag"))
        tails = (tail_rows(own, max(self.th.window_size - 1, 1)).groupBy(*S.KEY)
                 .agg(F.sort_array(F.collect_list(F.struct(*_RECORD))).alias("records")))
        none = F.array().cast(tails.schema["records"].dataType)
        return newest.join(tails, S.KEY, "left").withColumn("records", F.coalesce("records", none))


def fresh_enough(saved: DataFrame, as_of_us, ttl_s: float) -> DataFrame:
    """Saved state whose key was seen within the time to live; a key
    without a readable state is an error."""
    for c in (c for c in saved.columns if c != "last_us"):
        saved = saved.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"saved state without {c}"))).otherwise(F.col(c)))
    as_of = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    return saved.filter(as_of - F.col("seen_us") <= F.lit(int(ttl_s * 1_000_000)))
