"""Sliding-window evaluation of every key (W1-W11 with P1-P3).

For each sample, the window is the key's last N windowed records up to and
including it (a ROWS frame, not a time frame).  Everything is one pass of
built-in window functions over one partitioning and one ordering:

    partitionBy(KEY).orderBy(kind_rank, ts_us, <ties>)

so Spark plans a single Exchange + Sort for all frames (N rows, last
min(5, N) rows, previous row).  `kind_rank` puts windowed rows first in
each key so no-commit and unreadable rows never enter a window.  The
output stays hash-partitioned by KEY, so per-key steps downstream (latest
status, incident fold) reuse that exchange.
The lag trend (W8) compares the first and last thirds of a window whose
size changes during warm-up; it uses fixed row frames plus `nth_value` for
the warm-up rows, so no per-row arrays are built and every projection
stays inside whole-stage codegen (a higher-order lambda would not).

Rows of a key with equal times are ordered by `seq`, if the samples have
such a column (any sortable type: a sequence number, or the place in the
source files, see `sources.positions.with_arrival`), then by their values.
What is still tied is alike, so the result is defined either way.  `tie`
numbers the rows of one key, kind and time from 0 and carries that order to
everything that reads evaluated rows.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import THRESHOLD_SCHEMA, Thresholds, attach_thresholds
from ..functions import text as X
from ..session import written
from .skew import HotKeys, resolve

KIND_WINDOW = "window"
KIND_NO_COMMIT = "no_commit"
KIND_UNREADABLE = "unreadable"

STATUS_COLUMNS = [
    *S.KEY, "ts", "ts_us", "tie", "kind", "current_offset", "high_watermark", "current_lag",
    "n_records", "window_completeness", "consumption_rate", "lag_change_rate", "is_active",
    "time_since_last_move_s", "lag_trend", "status", "health", "prev_lag", "message",
]


def _cfg_lit(th: Thresholds) -> dict[str, Column]:
    return {f.name: F.lit(getattr(th, f.name)).cast(f.dataType) for f in THRESHOLD_SCHEMA.fields}


def _cfg_col() -> dict[str, Column]:
    return {f.name: F.col(f.name) for f in THRESHOLD_SCHEMA.fields}


def evaluate(samples: DataFrame, thresholds: Thresholds | DataFrame, *,
             messages: bool = True, passthrough: tuple[str, ...] = (), within: tuple[str, ...] = (),
             hot_key_rows: int | str | None = None) -> DataFrame:
    """samples (KEY, ts, ts_us, committed_offset, high_watermark, lag) ->
    evaluated rows (STATUS_COLUMNS), one per sample.

    `thresholds` is one Thresholds for every cluster, or a per-cluster table
    (cluster + threshold columns, e.g. from `resolve_thresholds`).  Frames
    need literal sizes: of a per-cluster table all distinct window sizes (a
    handful, bounded by configuration) get their fixed-offset values in the
    same pass, and each row picks those of its own size.

    `hot_key_rows`: keys with more samples than this (an int, or "auto":
    one shuffle partition's fair share, see operators/skew.py) are cut into
    time segments of about that many rows, each evaluated in its own task with
    an exact halo of the previous N-1 windowed records (see
    `_with_segments`), so one very hot key does not serialise the pass.
    `within` names further columns (without hot keys) that a window must not
    cross, such as the start of a key's stretch between two gaps.
    """
    if isinstance(thresholds, Thresholds):
        return _evaluate_n(samples, [thresholds.window_size], _cfg_lit(thresholds), messages, passthrough,
                           hot_key_rows, within)
    # Configuration table: one row per cluster, so collecting its distinct
    # window sizes is bounded by configuration, not by data.
    thresholds = thresholds.filter(F.col("window_size") >= 1)
    sizes = sorted(r[0] for r in thresholds.select("window_size").distinct().collect())
    return _evaluate_n(attach_thresholds(samples, thresholds), sizes or [1], _cfg_col(), messages, passthrough,
                       hot_key_rows, within)


def tie_order(df: DataFrame) -> list[str]:
    """The columns that order a key's samples of one time."""
    return [*(["seq"] if "seq" in df.columns else []), "committed_offset", "high_watermark"]


def _evaluate_n(samples: DataFrame, sizes: list[int], cfg: dict[str, Column], messages: bool,
                passthrough: tuple[str, ...] = (), hot_key_rows: int | str | None = None,
                within: tuple[str, ...] = ()) -> DataFrame:
    n_max, size = sizes[-1], cfg["window_size"]

    def by_size(value) -> Column:
        """value(k) for the row's own window size k."""
        out = value(sizes[0])
        for k in sizes[1:]:
            out = F.when(size == k, value(k)).otherwise(out)
        return out

    off, hwm, lag, ts = (F.col(c) for c in ("committed_offset", "high_watermark", "lag", "ts_us"))
    kind = (F.when(hwm.isNull(), F.lit(KIND_UNREADABLE))
            .when(off.isNull(), F.lit(KIND_NO_COMMIT))
            .otherwise(F.lit(KIND_WINDOW)))
    # Windowed rows sort first inside each key, so their frames never reach
    # a no-commit/unreadable row; values computed for those rows are discarded.
    df = samples.withColumn("kind", kind).withColumn(
        "_krank", F.when(F.col("kind") == KIND_WINDOW, 0).when(F.col("kind") == KIND_NO_COMMIT, 1).otherwise(2))

    part = [*S.KEY, *within]
    if hot_key_rows and not isinstance(hot_key_rows, HotKeys):
        # the decision, the segments and their halos read the samples
        df = written(df, f"samples-{uuid4().hex}")
    hot = resolve(df, hot_key_rows)
    if hot is not None:
        df = _with_segments(df, n_max, hot)
        part.append("_seg")
        passthrough = tuple(passthrough) + ("_own",)
    by_key = Window.partitionBy(*part).orderBy("_krank", "ts_us", *tie_order(df))
    running = by_key.rowsBetween(Window.unboundedPreceding, 0)
    # Every window value is an O(1)-per-row function: fixed-offset lag(),
    # row_number() and running first/last/nth_value.  Sliding-frame
    # aggregates would be re-evaluated over the whole frame for every row.
    # Windowed rows come first in each key, so row_number() is the number of
    # windowed records so far and n = min(row_number, N); when n = N the
    # window's first record is lag(x, N-1), otherwise it is the key's first.
    # With several sizes these hold for each row's own N.
    t_full = {k: max(k // 3, 1) for k in sizes}
    t_warm = max((n_max - 1) // 3, 1)
    t_max = max(t_full[n_max], t_warm)
    r_act = min(5, n_max)
    lag_offsets = sorted(set(range(2, t_max)) | {i for k in sizes for i in range(k - t_full[k], k) if i > 1})
    cols = [F.row_number().over(by_key).alias("_rn"),
            F.first(off).over(running).alias("_k_off"), F.first(ts).over(running).alias("_k_ts"),
            F.first(lag).over(running).alias("_k_lag"),
            F.lag(off, 1).over(by_key).alias("_off1"), F.lag(ts, 1).over(by_key).alias("_ts1"),
            F.lag("_krank", 1).over(by_key).alias("_krank1"),
            F.lag(lag, 1).over(by_key).alias("prev_lag")]
    for k in sizes:
        if k > 1:
            cols += [F.lag(off, k - 1).over(by_key).alias(f"_w_off{k}"), F.lag(ts, k - 1).over(by_key).alias(f"_w_ts{k}")]
    cols += [F.lag(off, k).over(by_key).alias(f"_off{k}") for k in range(2, r_act)]
    cols += [F.lag(lag, k).over(by_key).alias(f"_lag{k}") for k in lag_offsets]
    cols += [F.nth_value(lag, i).over(running).alias(f"_nth{i}") for i in range(1, t_warm + 1)]
    df = df.select("*", *cols)
    def lag_k(k: int) -> Column:
        return lag if k == 0 else (F.col("prev_lag") if k == 1 else F.col(f"_lag{k}"))

    n = F.least(F.col("_rn"), size)
    full = F.col("_rn") >= size
    f_off = F.when(full, by_size(lambda k: off if k == 1 else F.col(f"_w_off{k}"))).otherwise(F.col("_k_off"))
    f_ts = F.when(full, by_size(lambda k: ts if k == 1 else F.col(f"_w_ts{k}"))).otherwise(F.col("_k_ts"))
    f_lag = F.when(full, by_size(lambda k: lag_k(k - 1))).otherwise(F.col("_k_lag"))
    df = df.select("*", n.alias("_n"), f_off.alias("_f_off"), f_ts.alias("_f_ts"), f_lag.alias("_f_lag"))
    n = F.col("_n")
    dt = (ts - F.col("_f_ts")) / F.lit(1e6)
    rate = (F.when((n < 2) | (off == F.col("_f_off")) | (dt == 0), F.lit(0.0))
            .otherwise((off - F.col("_f_off")) / dt))
    lag_rate = F.when((n < 2) | (dt == 0), F.lit(0.0)).otherwise((lag - F.col("_f_lag")) / dt)
    # >1 distinct offset among the last min(5, n) records <=> one of them
    # differs from the current offset
    moved = [F.coalesce(F.col(f"_off{k}") != off, F.lit(False)) & (size > k) for k in range(1, max(r_act, 2))]
    active = (n >= 2) & reduce(lambda x, y: x | y, moved)

    third = F.greatest(F.floor(n / 3), F.lit(1)).cast("int")
    warm_first = None
    for t in range(1, t_warm + 1):
        acc = sum((F.col(f"_nth{i}") for i in range(2, t + 1)), F.col("_nth1"))
        warm_first = (F.when(third == t, acc) if warm_first is None else warm_first.when(third == t, acc))
    last_sum = None
    for t in range(1, t_max + 1):
        acc = sum((lag_k(k) for k in range(1, t)), lag)
        last_sum = F.when(third == t, acc) if last_sum is None else last_sum.when(third == t, acc)
    first_full = by_size(lambda k: sum((lag_k(i) for i in range(k - t_full[k], k)), F.lit(0).cast("long")))
    first_sum = F.when(n == size, first_full).otherwise(warm_first)
    # materialise the thirds once: inlining them into every branch of the
    # trend/status/health CASEs bloats the generated code past codegen limits
    df = df.select("*", (first_sum / third).alias("_ta"), (last_sum / third).alias("_tb"))
    a, b = F.col("_ta"), F.col("_tb")
    df = df.withColumn("_rel", F.when(a > 0, (b - a) / a))  # guarded: ANSI division
    rel = F.col("_rel")
    trend = (F.when(n < 3, F.lit(S.UNKNOWN))
             .when((a == 0) & (b == 0), F.lit(S.STABLE))
             .when(a <= 0, F.when(b > 0, F.lit(S.INCREASING)).otherwise(F.lit(S.STABLE)))
             .when(F.abs(rel) < cfg["trend_threshold"], F.lit(S.STABLE))
             .when(rel > 0, F.lit(S.INCREASING))
             .otherwise(F.lit(S.DECREASING)))

    df = df.select("*", rate.alias("_rate"), lag_rate.alias("_lrate"), active.alias("_active"), trend.alias("_trend"))
    # last offset change at or before this row (anywhere in the history);
    # clipped to the window start below, so only in-window changes count.
    # This second window stands between the trend and the status, so that the
    # code generated for either side stays below the JIT compiler's limit
    same = F.coalesce((ts == F.col("_ts1")) & (F.col("_krank") == F.col("_krank1")), F.lit(False))
    df = df.select("*", F.last(F.when(off != F.col("_off1"), ts), ignorenulls=True).over(running).alias("_run"),
                   (F.col("_rn") - F.last(F.when(~same, F.col("_rn")), ignorenulls=True).over(running)).cast("int").alias("tie"))
    idle = F.when(n < 2, F.lit(0.0)).otherwise(
        (ts - F.greatest(F.coalesce(F.col("_run"), F.col("_f_ts")), F.col("_f_ts"))) / F.lit(1e6))
    df = df.withColumn("_idle", idle)
    if messages:
        df = df.withColumn("_dur", X.duration_text_rounded(F.col("_idle")))
    rate, lag_rate, active, idle, trend = (F.col(c) for c in ("_rate", "_lrate", "_active", "_idle", "_trend"))

    status = (F.when(~active,
                     F.when(lag == 0, F.lit(S.EMPTY))
                     .when(idle > cfg["inactivity_s"], F.lit(S.STOPPED))
                     .otherwise(F.lit(S.STALLED)))
              .when(rate < cfg["stalled_rate"], F.lit(S.STALLED))
              .when(lag == 0, F.lit(S.EMPTY))
              .when(lag_rate > cfg["rapid_rate"], F.lit(S.LAGGING))
              .otherwise(F.lit(S.ACTIVE)))
    df = df.withColumn("_status", status)
    status = F.col("_status")
    health = (F.when(status.isin(S.STOPPED, S.STALLED), F.lit(S.CRITICAL))
              .when(status == S.LAGGING,
                    F.when((trend == S.INCREASING) & (lag_rate > cfg["rapid_rate"]), F.lit(S.CRITICAL))
                    .otherwise(F.lit(S.WARNING)))
              .when(status.isin(S.EMPTY, S.ACTIVE),
                    F.when((trend == S.INCREASING) & (lag > cfg["lag_floor"]), F.lit(S.WARNING))
                    .otherwise(F.lit(S.GOOD)))
              .otherwise(F.lit(S.WARNING)))

    is_win = F.col("kind") == KIND_WINDOW
    is_nc = F.col("kind") == KIND_NO_COMMIT
    ok = is_win & (n >= cfg["min_size"])      # evaluated (enough records)
    insufficient = is_win & (n < cfg["min_size"])

    out = [
        *S.KEY, "ts", "ts_us", "tie", "kind",
        F.when(is_win, off).otherwise(F.when(is_nc, F.lit(0))).cast("long").alias("current_offset"),
        hwm.alias("high_watermark"),
        F.when(is_win, lag).otherwise(F.when(is_nc, F.lit(0))).cast("long").alias("current_lag"),
        F.when(is_win, n).otherwise(F.when(is_nc, F.lit(0))).cast("int").alias("n_records"),
        F.when(is_win, n / cfg["window_size"] * 100).otherwise(F.when(is_nc, F.lit(0.0)))
        .cast("double").alias("window_completeness"),
        F.when(ok, rate).otherwise(F.when(is_win | is_nc, F.lit(0.0))).alias("consumption_rate"),
        F.when(ok, lag_rate).otherwise(F.when(is_win | is_nc, F.lit(0.0))).alias("lag_change_rate"),
        F.when(ok, active).otherwise(F.when(is_win | is_nc, F.lit(False))).alias("is_active"),
        F.when(ok, idle).otherwise(F.when(is_win | is_nc, F.lit(0.0))).alias("time_since_last_move_s"),
        F.when(ok, trend).when(insufficient, F.lit(S.UNKNOWN)).when(is_nc, F.lit("")).alias("lag_trend"),
        F.when(ok, status).when(is_win | is_nc, F.lit(S.UNKNOWN)).alias("status"),
        F.when(ok, health).when(is_win | is_nc, F.lit(S.WARNING)).alias("health"),
        F.when(is_win, F.col("prev_lag")).cast("long").alias("prev_lag"),
        *passthrough,
    ]
    res = df.select(*out, message_text(cfg["min_size"], ok=ok, active=active, status=status, rate=rate, lag_rate=lag_rate, lag=lag,
                                       dur=F.col("_dur"), n=n).alias("message") if messages else F.lit(None).cast("string").alias("message"))
    res = res.select(*STATUS_COLUMNS, *passthrough)
    if hot is not None:
        res = res.filter(F.col("_own")).drop("_own")
    return res


def message_text(min_size: Column, *, ok: Column | None = None, active="is_active", status="status", rate="consumption_rate",
                 lag_rate="lag_change_rate", lag="current_lag", dur: Column | None = None, n="n_records") -> Column:
    """The seven status templates plus the two guard messages, from the
    values of an evaluated row (its columns, unless given)."""
    active, status, rate, lag_rate, lag, n = (F.col(c) if isinstance(c, str) else c for c in (active, status, rate, lag_rate, lag, n))
    is_win = F.col("kind") == KIND_WINDOW
    dur = X.duration_text_rounded(F.col("time_since_last_move_s")) if dur is None else dur
    evaluated = (
        F.when(status == S.EMPTY,
               F.when(~active, F.lit(X.MSG_IDLE_EMPTY)).otherwise(F.lit(X.MSG_ACTIVE_EMPTY)))
        .when(status == S.STOPPED, F.format_string(X.MSG_STOPPED, dur, lag))
        .when(status == S.STALLED,
              F.when(~active, F.format_string(X.MSG_STALLED_IDLE, dur))
              .otherwise(F.format_string(X.MSG_STALLED_SLOW, rate)))
        .when(status == S.LAGGING, F.format_string(X.MSG_LAGGING, lag_rate))
        .otherwise(F.format_string(X.MSG_ACTIVE, rate, lag)))
    return (F.when(is_win & (n >= min_size) if ok is None else ok, evaluated)
            .when(is_win, F.format_string(X.MSG_INSUFFICIENT, n, min_size))
            .when(F.col("kind") == KIND_NO_COMMIT, F.lit(S.NO_COMMIT_MESSAGE)))


def partition_status(evaluated: DataFrame) -> DataFrame:
    """Rows that carry a status (windowed and no-commit); unreadable
    partitions only count in the group's partition_count."""
    return evaluated.filter(F.col("kind") != KIND_UNREADABLE)


def latest_per_key(status: DataFrame) -> DataFrame:
    """Newest evaluated row per KEY (the status store keeps only that).

    `max_by` over a struct (a sort aggregate) instead of a window: partial
    aggregation runs map-side, and an input hash-partitioned by KEY (the
    evaluation's own exchange) needs no new shuffle.
    """
    cols = [c for c in status.columns if c not in S.KEY]
    order = F.struct(*[c for c in ("ts_us", "kind", "tie") if c in cols])  # of one time, windowed rows come last
    return (status.groupBy(*S.KEY)
            .agg(F.max_by(F.struct(*cols), order).alias("_r"))
            .select(*S.KEY, "_r.*"))


def _with_segments(df: DataFrame, n_max: int, hot: DataFrame) -> DataFrame:
    """Cut the hot keys (`hot`: KEY, _nseg, _lo, _hi) into time segments and
    add to every segment, as halo rows (`_own` = false), exactly the last
    H = max(N-1, 1) windowed records before it - the only rows any window
    of the segment can reach.

    All bookkeeping happens on a per-(key, segment) table whose size is
    about (rows / hot_rows): cumulative windowed counts C, and for each
    segment t the furthest later segment that still needs t's rows,
    D(t) = max{u : C(u) <= C(t) + H - 1} (a RANGE frame over C).  A tail row
    of t with reverse rank j is copied to target d in (t, D(t) + 1] iff
    (j - 1) + C(d - 1) - C(t) < H.  No inequality join, no cross join.
    Other keys keep one segment (0) and get no halo rows.
    """
    h = max(n_max - 1, 1)
    is_win = F.col("kind") == KIND_WINDOW
    d = df.join(hot, S.KEY, "left")
    frac = (F.col("ts_us") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1).cast("double")
    d = d.withColumn("_rseg", F.when(F.col("_nseg").isNull(), F.lit(0)).otherwise(
        F.least(F.floor(frac * F.col("_nseg")), F.col("_nseg") - 1)).cast("long"))
    d = d.withColumn("_hot", F.col("_nseg").isNotNull()).drop("_nseg", "_lo", "_hi")

    by_seg = Window.partitionBy(*S.KEY).orderBy("_rseg")
    segs = (d.filter(F.col("_hot")).groupBy(*S.KEY, "_rseg")
            .agg(F.count_if(is_win).cast("long").alias("_c"))
            .withColumn("_seg", (F.row_number().over(by_seg) - 1).cast("long"))
            .withColumn("_C", F.sum("_c").over(by_seg.rowsBetween(Window.unboundedPreceding, 0))))
    by_c = Window.partitionBy(*S.KEY).orderBy("_C").rangeBetween(0, h - 1)
    segs = segs.withColumn("_reach", F.max("_seg").over(by_c) + 1)

    d = (d.join(segs.select(*S.KEY, "_rseg", "_seg"), S.KEY + ["_rseg"], "left")
         .withColumn("_seg", F.coalesce(F.col("_seg"), F.lit(0).cast("long"))).drop("_rseg"))
    cols = [c for c in d.columns if c != "_hot"]
    own = d.select(*cols, F.lit(True).alias("_own"))

    last_first = Window.partitionBy(*S.KEY, "_seg").orderBy(*[F.col(c).desc() for c in ("ts_us", *tie_order(df))])
    tails = (d.filter(F.col("_hot") & is_win).withColumn("_j", F.row_number().over(last_first))
             .filter(F.col("_j") <= h)
             .join(segs.select(*S.KEY, "_seg", F.col("_C").alias("_Cs"), "_reach"), S.KEY + ["_seg"]))
    targets = segs.select(*S.KEY, F.col("_seg").alias("_tgt"), (F.col("_C") - F.col("_c")).alias("_Cbefore"))
    halo = (tails.select("*", F.explode(F.sequence(F.col("_seg") + 1, F.col("_reach"))).alias("_tgt"))
            .join(targets, S.KEY + ["_tgt"])
            .filter((F.col("_j") - 1) + (F.col("_Cbefore") - F.col("_Cs")) < h)
            .withColumn("_seg", F.col("_tgt")))
    return own.unionByName(halo.select(*cols, F.lit(False).alias("_own")))
