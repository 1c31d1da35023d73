"""Plain-Python model of the evaluation and event rules (one key at a
time), used as the differential oracle for the Spark operators."""

from __future__ import annotations


def evaluate_window(recs, th):
    """recs: list of (ts_us, offset, lag) for the window (oldest first)."""
    n = len(recs)
    out = {"n": n, "status": "UNKNOWN", "trend": "UNKNOWN", "health": "WARNING",
           "rate": 0.0, "lrate": 0.0, "active": False, "idle": 0.0}
    if n < th.min_size:
        return out
    last = recs[-1]
    active = n >= 2 and len({r[1] for r in recs[-min(5, n):]}) > 1
    idle = 0.0
    if n >= 2:
        idle = (last[0] - recs[0][0]) / 1e6
        for i in range(n - 2, -1, -1):
            if recs[i][1] != last[1]:
                idle = (last[0] - recs[i + 1][0]) / 1e6
                break
    dt = (last[0] - recs[0][0]) / 1e6
    rate = 0.0 if n < 2 or recs[0][1] == last[1] or dt == 0 else (last[1] - recs[0][1]) / dt
    lrate = 0.0 if n < 2 or dt == 0 else (last[2] - recs[0][2]) / dt
    lag = last[2]
    if not active:
        st = "EMPTY" if lag == 0 else ("STOPPED" if idle > th.inactivity_s else "STALLED")
    elif rate < th.stalled_rate:
        st = "STALLED"
    elif lag == 0:
        st = "EMPTY"
    elif lrate > th.rapid_rate:
        st = "LAGGING"
    else:
        st = "ACTIVE"
    if n < 3:
        tr = "UNKNOWN"
    else:
        t = max(n // 3, 1)
        a = sum(r[2] for r in recs[:t]) / t
        b = sum(r[2] for r in recs[n - t:]) / t
        if a == 0 and b == 0:
            tr = "STABLE"
        elif a <= 0:
            tr = "INCREASING" if b > 0 else "STABLE"
        else:
            rel = (b - a) / a
            tr = "STABLE" if abs(rel) < th.trend_threshold else ("INCREASING" if rel > 0 else "DECREASING")
    if st in ("STOPPED", "STALLED"):
        hl = "CRITICAL"
    elif st == "LAGGING":
        hl = "CRITICAL" if tr == "INCREASING" and lrate > th.rapid_rate else "WARNING"
    elif st in ("EMPTY", "ACTIVE"):
        hl = "WARNING" if tr == "INCREASING" and lag > th.lag_floor else "GOOD"
    else:
        hl = "WARNING"
    out.update(status=st, trend=tr, health=hl, rate=rate, lrate=lrate, active=active, idle=idle)
    return out


def evaluate_series(series, th):
    """series: list of (ts_us, offset, lag) in time order -> list of dicts."""
    res = []
    for i in range(len(series)):
        res.append(evaluate_window(series[max(0, i - th.window_size + 1):i + 1], th))
    return res


def fold_events(rows, th):
    """rows: list of (ts_us, status, lrate, lag, n, prev_lag) -> [(ts_us, type)]."""
    gate = th.gate_s * 1e6
    prev, last, out = None, None, []
    for ts, st, lrate, lag, n, prev_lag in rows:
        if last is not None and ts - last < gate:
            continue
        if prev is not None and prev != st:
            t = None
            if st == "STOPPED" and prev in ("ACTIVE", "LAGGING"):
                t = "consumer_stopped"
            elif st == "STALLED" and prev == "ACTIVE":
                t = "consumer_stalled"
            elif st in ("ACTIVE", "EMPTY") and prev in ("STOPPED", "STALLED"):
                t = "consumer_recovered"
            if t:
                out.append((ts, t))
                last = ts
        if lrate > th.rapid_rate * 2 and lag > th.lag_floor:
            out.append((ts, "rapid_lag_increase"))
            last = ts
        if lag == 0 and n > 2 and prev_lag is not None and prev_lag > th.lag_floor:
            out.append((ts, "lag_cleared"))
        prev = st
    return out
