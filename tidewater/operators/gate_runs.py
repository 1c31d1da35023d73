"""The gate fold over all runs of an Arrow batch at once.

A run is a stretch of one key's rows in time order.  What follows an event
that sets the gate depends on its row alone: the rows within the gate are
passed over, the row after them is compared with the event row's status, and
from there on each row with the one before it.  So every row has one next
event row, found for all rows with a few array operations; a fold follows
these links from the entry state of its run, and the state that any entry
leaves behind is that of the last row on its chain.

States are (previous status, time of the last gate-setting event), with NONE
and NEVER where there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Event codes used inside the fold (type, severity), in emission order.
EV_STOPPED, EV_STALLED, EV_RECOVERED, EV_RAPID, EV_CLEARED = 1, 2, 3, 4, 5
NONE = -100  # "no previous status"
NEVER = -(1 << 62)  # no event so far


def starts_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """For each row, whether it differs in `names` from the row before (the first does)."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for name in names:
        col = batch.column(name)
        if len(col) > 1:
            a, b = col.slice(1), col.slice(0, len(col) - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            out[1:] |= differs
            if col.null_count:
                out[1:] |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def key_at(batch: pa.RecordBatch, names: list[str], i: int) -> tuple:
    return tuple(batch.column(name)[i].as_py() for name in names)


class GateRuns:
    def __init__(self, starts, ts, st, e4, e5, gate, transition):
        """`starts`: first row of each run (from 0); `gate`: one length per run;
        `transition(prev, cur)` gives the event codes of status changes (E3)."""
        self.starts, self.ts, self.st, self.e4, self.e5 = starts, ts, st, e4, e5
        self.gate, self.transition = gate, transition
        n = self.n = len(ts)
        self.ends = np.r_[starts[1:], n]
        self.run = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.end = self.ends[self.run]
        at = np.arange(n)
        change = (transition(np.r_[st[:1], st[:-1]], st) != 0) | e4
        self.nxt = np.r_[np.minimum.accumulate(np.where(change, at, n)[::-1])[::-1], n, n]
        self.open_at = np.maximum(self.first_from(self.run, ts + gate[self.run]), at + 1)
        self.next, _ = self.step(st, self.open_at, self.end)

    def first_from(self, run, t) -> np.ndarray:
        """For each pair (run, time), the run's first row not before that time, or its end."""
        base = self.ts[self.starts]
        rel = self.ts - base[self.run]
        span = int(rel.max()) + 2
        if len(base) * span < 1 << 62:
            asked = np.clip(np.maximum(t, base[run]) - base[run], 0, span - 1)
            return np.searchsorted(self.run * span + rel, run * span + asked)
        return np.array([a + np.searchsorted(self.ts[a:b], x) for a, b, x in
                         zip(self.starts[run], self.ends[run], t)], np.int64).reshape(len(run))

    def step(self, prev, first, end) -> tuple[np.ndarray, np.ndarray]:
        """The next gate-setting row (or n) when row `first` is the first one
        after the gate and is compared with `prev`; and whether it is that row."""
        inside = first < end
        row = np.minimum(first, self.n - 1)
        direct = inside & ((self.transition(prev, self.st[row]) != 0) | self.e4[row])
        k = np.where(direct, row, self.nxt[row + 1])
        return np.where(inside & (k < end), k, self.n), direct

    def _enter(self, run, prev, last):
        closed = last > NEVER
        first = np.where(closed, self.first_from(run, np.where(closed, last + self.gate[run], NEVER)), self.starts[run])
        return first, self.step(prev, first, self.ends[run])[0]

    def _leave(self, run, prev, last, first, tail):
        """State at the end of `run` of an entry whose first evaluated row is
        `first` and whose last gate-setting row is `tail` (n: none)."""
        end = self.ends[run]
        fired = tail < self.n
        t = np.minimum(tail, self.n - 1)
        moved = np.where(fired, self.open_at[t] < end, first < end)
        return (np.where(moved, self.st[end - 1], np.where(fired, self.st[t], prev)),
                np.where(fired, self.ts[t], last))

    def last_on_chain(self) -> np.ndarray:
        """For each row, the last row on the chain of events that starts with one there (n for n)."""
        at = np.arange(self.n + 1)
        tail = np.where(np.r_[self.next, self.n] < self.n, np.r_[self.next, self.n], at)
        while True:
            further = tail[tail]
            if np.array_equal(further, tail):
                return tail
            tail = further

    def through(self, run, prev, last, tails) -> tuple[np.ndarray, np.ndarray]:
        """The states that entries (prev, last) into runs leave behind."""
        first, k = self._enter(run, prev, last)
        return self._leave(run, prev, last, first, tails[k])

    def after_row(self, row, tails):
        """The states left behind if the row is the first one evaluated: where
        it sets the gate, and where it does not (then with NEVER if no event follows)."""
        run = self.run[row]
        fired = self._leave(run, self.st[row], self.ts[row], row, tails[row])
        k = self.nxt[row + 1]
        k = np.where(k < self.ends[run], k, self.n)
        return fired, self._leave(run, self.st[row], np.full(len(row), NEVER), row, tails[k])

    def fold(self, prev, last):
        """(rows, event codes, prev, last) for the entry states of all runs."""
        run = np.arange(len(self.starts))
        first, entry = self._enter(run, prev, last)
        follow, n = self.next.tolist(), self.n
        chain, tail = [], entry.copy()
        for r, k in enumerate(entry.tolist()):
            while k < n:
                chain.append(k)
                tail[r] = k
                k = follow[k]
        chain = np.asarray(chain, np.int64)
        # evaluated rows: from the first one after a gate to the one that sets it again
        frm = np.r_[first, self.open_at[chain]]
        to = np.r_[entry, self.next[chain]]
        end = np.r_[self.ends, self.end[chain]]
        before = np.r_[prev, self.st[chain]]
        seen = frm < end
        frm, to, end, before = frm[seen], to[seen], end[seen], before[seen]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, frm, 1)
        np.add.at(edge, np.minimum(to + 1, end), -1)
        cleared = np.flatnonzero(self.e5 & (np.cumsum(edge[:n]) > 0))
        fires = to < n
        at, frm, before = to[fires], frm[fires], before[fires]
        codes = self.transition(np.where(at == frm, before, self.st[at - 1]), self.st[at])
        rapid = at[self.e4[at]]
        rows = np.r_[at[codes != 0], rapid, cleared]
        codes = np.r_[codes[codes != 0], np.full(len(rapid), EV_RAPID), np.full(len(cleared), EV_CLEARED)]
        order = np.lexsort((codes, rows))
        return rows[order], codes[order].astype(np.int32), *self._leave(run, prev, last, first, tail)
