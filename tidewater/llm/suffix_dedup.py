"""Removal of byte passages that an earlier document already holds.

A byte is removed if a `LENGTH`-byte string that covers it also starts in a
document with a smaller id.  Strings are judged on the input, whole texts as
UTF-8, and never cross documents.

Sorting every suffix of a corpus would move each byte's context through a
shuffle, so only suffixes that can repeat are sorted:

1. Each window of LENGTH bytes has an anchor: the leftmost smallest hash of
   its 16-byte grams.  Equal windows have equal anchors at equal offsets.
   Anchors' hashes are dealt to shards, which find those that more than one
   document holds (a superset is harmless).
2. For a shared anchor, a block of documents sends the context that its
   windows span (at most 84 bytes), once per distinct context with the
   smallest and largest id in the block, so a passage in a third of all
   documents makes one row per block.  An anchor with more than HOT places
   in all (a frequent line with many different surroundings) is split: each
   of its windows travels as a context of its own to a shard given by its
   bytes, so that no shard gathers all its surroundings.
3. A shard sorts the suffixes that start at its contexts' windows: mergesort
   in classes of equal anchor and offset, where two suffixes are compared
   through prefix polynomial hashes, the length of their common extension
   found by binary search.  Neighbours that agree on LENGTH bytes form a
   group, checked byte by byte against hash collisions; the group's smallest
   id is returned for every window.
4. Blocks mark the windows whose smallest id is below their own and cut the
   bytes they cover.

Texts equal to an earlier document's are recognised beforehand by their
digest and take no part: all they hold starts in the earlier one.

Blocks and shards have about the same size whatever the corpus; the text is
dealt to blocks once and that exchange serves all three passes.

Defined results: a null or empty text has no bytes; a null doc_id loses
nothing and counts for no other; rows that share a doc_id never remove each
other's bytes; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, mix, ready, release, salt, shuffle_partitions, stored

LENGTH = 50
GRAM = 16
_SPAN = LENGTH - GRAM + 1           # grams in a window
_WIDE = LENGTH + _SPAN - 1          # bytes that the windows of one anchor can span
_CHUNK = 1 << 16                    # windows at a time; small enough for the processor's cache
_MASK = np.uint64((1 << 17) - 1)
_SORTED = 1 << 14                   # contexts sorted at a time
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SHARD_ANCHORS = 1_000_000
HOT = 10_000                        # places of one anchor from which its windows go their own ways
_U64, _I64 = np.dtype("<u8"), np.dtype("<i8")


# --- anchors -------------------------------------------------------------------

class Block:
    """The texts of a block laid end to end."""

    def __init__(self, ids: list[int | None], texts: list[str | None], copies: set[tuple[int, int]]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        noted = {doc for doc, _ in copies}
        self.copy = [i in noted and (i, int(hashlib.md5(r).hexdigest()[:15], 16)) in copies for i, r in zip(ids, raw)]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw) + bytes(_WIDE), np.uint8)
        self.ids = np.array([0 if i is None else i for i in ids], _I64)
        ends = np.zeros(len(self.bytes), bool)
        for i, (a, n) in enumerate(zip(self.starts, self.sizes)):
            if ids[i] is not None and not self.copy[i] and n >= LENGTH:
                ends[a:a + n - LENGTH + 1] = True
        self.window = ends

    def chunks(self):
        """(first, end) byte of each chunk: whole texts, or a part of a long
        one, cut at offsets counted from its own first byte.  No run of
        windows is cut where a text's neighbours decide, so every pass sees
        the same contexts in whatever order it receives the rows."""
        a = 0
        for start, end in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if end - a > _CHUNK and start > a:
                yield a, start
                a = start
            while end - a > _CHUNK:
                yield a, a + _CHUNK
                a += _CHUNK
        if a < self.starts[-1]:
            yield a, int(self.starts[-1])

    def anchors(self):
        """Per chunk: (gram hash, first window, number of windows, offset of
        the anchor in the first window, row of the document)."""
        for a, b in self.chunks():
            at = np.flatnonzero(self.window[a:b])
            if not len(at):
                continue
            part = self.bytes[a:b + LENGTH - 1]
            word = np.ndarray((len(part) - 7,), _U64, part.tobytes(), strides=(1,))
            h = word[:-8] * np.uint64(0xC2B2AE3D27D4EB4F) ^ word[8:] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            low = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
            for d in (1, 2, 4, 8, 16, _SPAN - 32):
                low = np.minimum(low[:-d], low[d:])
            arg = (low[at] & _MASK).astype(np.int64)
            first = np.flatnonzero(np.r_[True, (arg[1:] != arg[:-1]) | (at[1:] != at[:-1] + 1)])
            start, anchor = at[first], arg[first]
            count = np.diff(np.r_[first, len(at)])
            start = start + a
            yield h[anchor], start, count, anchor + a - start, np.searchsorted(self.starts, start, "right") - 1

    def contexts(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(n, _WIDE) bytes from each first window on, zero beyond its last."""
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, _WIDE)
        ctx = view[start].copy()
        ctx[np.arange(_WIDE) >= (count + LENGTH - 1)[:, None]] = 0
        return ctx


def prefix_hashes(ctx: np.ndarray) -> np.ndarray:
    """P[i] holds the polynomial hashes of the first i bytes of every row."""
    columns = np.ascontiguousarray(ctx.T).astype(np.uint64) + np.uint64(1)
    p = np.zeros((len(columns) + 1, len(ctx)), np.uint64)
    for i, c in enumerate(columns):
        np.multiply(p[i], _BASE, out=p[i + 1])
        p[i + 1] += c
    return p


_POWERS = np.array([pow(int(_BASE), i, 1 << 64) for i in range(_WIDE + 1)], np.uint64)


def context_ids(ctx: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """64-bit hashes of contexts, taken in words of eight bytes."""
    words = np.zeros((len(ctx), -(-_WIDE // 8) * 8), np.uint8)
    words[:, :_WIDE] = ctx
    h = mix((count.astype(np.uint64) << np.uint64(8) | offset.astype(np.uint64)) + salt(1))
    for w in words.view(_U64).T:
        h = (h ^ w) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return mix(h)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


# --- the sort --------------------------------------------------------------------

class Suffixes:
    """Suffixes (context row, start) compared through prefix hashes."""

    def __init__(self, ctx: np.ndarray, row: np.ndarray, start: np.ndarray):
        self.ctx, self.row, self.start = ctx, row, start
        self.p = prefix_hashes(ctx).ravel()
        self.step = len(ctx)
        self.at = start * self.step + row
        self.full = self.p[self.at + LENGTH * self.step] - self.p[self.at] * _POWERS[LENGTH]
        flat = np.ascontiguousarray(ctx).ravel()
        words = np.ndarray((max(0, len(flat) - 7),), ">u8", flat.tobytes(), strides=(1,))
        self.head = words[row * ctx.shape[1] + start].astype(np.uint64)   # the first bytes settle most comparisons

    def _hash(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = self.at[x]
        return self.p[at + n * self.step] - self.p[at] * _POWERS[n]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most LENGTH, by binary search."""
        lo = np.where(self.full[x] == self.full[y], LENGTH, 0)
        todo = np.flatnonzero(lo == 0)
        a, b = np.zeros(len(todo), np.int64), np.full(len(todo), LENGTH - 1)
        x, y = x[todo], y[todo]
        while len(todo) and (a < b).any():
            mid = (a + b + 1) >> 1
            same = self._hash(x, mid) == self._hash(y, mid)
            a, b = np.where(same, mid, a), np.where(same, b, mid - 1)
        lo[todo] = a
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y (or equals it, where asked)."""
        hx, hy = self.head[x], self.head[y]
        out = hx < hy
        tie = np.flatnonzero(hx == hy)
        x, y = x[tie], y[tie]
        n = self.common(x, y)
        equal = n == LENGTH
        out[tie[equal]] = or_equal[tie[equal]]
        d = np.flatnonzero(~equal)
        flat, width = self.ctx.ravel(), self.ctx.shape[1]
        cx = flat[self.row[x[d]] * width + self.start[x[d]] + n[d]]
        cy = flat[self.row[y[d]] * width + self.start[y[d]] + n[d]]
        out[tie[d]] = cx < cy
        return out

    def sort(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mergesort of `order` within classes: position i belongs to the
        class that occupies [lo[i], hi[i]).  All classes merge together."""
        first = np.flatnonzero((np.arange(len(order)) - lo) % 2 == 0)      # runs of one: a swap where needed
        first = first[first + 1 < hi[first]]
        if len(first):
            swap = first[self.less(order[first + 1], order[first], np.zeros(len(first), bool))]
            order = order.copy()
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
        width = 2
        while True:
            active = np.flatnonzero(hi - lo > width)
            if not len(active):
                return order
            l, h = lo[active], hi[active]
            run = l + (active - l) // (2 * width) * (2 * width)     # start of the pair of runs
            middle = np.minimum(run + width, h)
            end = np.minimum(run + 2 * width, h)
            left = active < middle
            a, b = np.where(left, middle, run), np.where(left, end, middle)   # the sibling run
            base = a.copy()
            x = order[active]
            while True:                                             # rank in the sibling run
                go = np.flatnonzero(a < b)
                if not len(go):
                    break
                mid = (a[go] + b[go]) >> 1
                # an element of the left run precedes equal ones of the right run
                before = self.less(order[mid], x[go], ~left[go])
                a[go], b[go] = np.where(before, mid + 1, a[go]), np.where(before, b[go], mid)
            own = np.where(left, active - run, active - middle)
            out = order.copy()
            out[run + own + (a - base)] = x
            order, width = out, 2 * width

    def same_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), bool)
        view = np.lib.stride_tricks.sliding_window_view(self.ctx.ravel(), LENGTH)
        at = self.row * self.ctx.shape[1] + self.start
        for i in range(0, len(x), 200_000):
            j = slice(i, i + 200_000)
            out[j] = (view[at[x[j]]] == view[at[y[j]]]).all(1)
        return out


def smallest_ids(key: np.ndarray, ctx: np.ndarray, count: np.ndarray, offset: np.ndarray,
                 doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every context: (row, window, smallest doc among
    all contexts that hold the window's bytes)."""
    row = np.repeat(np.arange(len(key)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    cls = mix(key[row] ^ mix((offset[row] - start).astype(np.uint64) + salt(3)))
    order = np.argsort(cls, kind="stable")
    sorted_cls = cls[order]
    edge = np.flatnonzero(np.r_[True, sorted_cls[1:] != sorted_cls[:-1]])
    size = np.diff(np.r_[edge, len(order)])
    lo = np.repeat(edge, size)
    hi = lo + np.repeat(size, size)
    sx = Suffixes(ctx, row, start)
    order = sx.sort(order, lo, np.where(hi - lo > 2, hi, lo))       # two need no order to be compared
    near = np.flatnonzero((lo[1:] == lo[:-1])) + 1                  # has a left neighbour in its class
    x, y = order[near - 1], order[near]
    hit = sx.full[x] == sx.full[y]                                  # a common extension of LENGTH
    hit[hit] = sx.same_bytes(x[hit], y[hit])
    joined = np.zeros(len(order), bool)
    joined[near[hit]] = True
    group = np.cumsum(~joined) - 1
    low = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, group, doc[row[order]])
    least = np.empty(len(order), np.int64)
    least[order] = low[group]
    return row, start, least


# --- the passes --------------------------------------------------------------------

def _block(docs: pa.Table, notes: pa.Table) -> Block:
    """The block's texts; of those in `notes` (id and digest of texts that an
    earlier document holds too) no windows are taken."""
    copies = set()
    if notes.num_rows:
        own = notes.filter(pc.is_valid(notes.column("doc")))
        copies = set(zip(own.column("doc").to_pylist(), own.column("half").to_pylist()))
    return Block(docs.column("__doc").to_pylist(), docs.column("__text").to_pylist(), copies)


def _binary(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _send_anchors(shards: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        release()
        out = {"shard": [], "block": [], "grams": [], "many": [], "places": []}
        if docs.num_rows:
            found = [(h, row) for h, _, _, _, row in _block(docs, notes).anchors()]
            if found:
                h, row = (np.concatenate(c) for c in zip(*found))
                order = np.argsort(h, kind="stable")                # rows stay in order within a hash
                h, row = h[order], row[order]
                edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                ends = np.r_[edge[1:], len(h)]
                many = row[edge] != row[ends - 1]
                places = np.minimum(ends - edge, HOT + 1).astype(np.uint16)
                h = h[edge]
                shard = _shard(h, shards)
                block = docs.column("__block")[0].as_py()
                for s in np.unique(shard):
                    own = shard == s
                    out["shard"].append(int(s))
                    out["block"].append(block)
                    out["grams"].append(h[own].astype(np.uint32).tobytes())
                    out["many"].append(many[own].tobytes())
                    out["places"].append(places[own].tobytes())
        return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()),
                                               ("grams", pa.binary()), ("many", pa.binary()),
                                               ("places", pa.binary())]))
    return run


def _shared(table: pa.Table) -> pa.Table:
    """The grams of each block that some other document holds too, and which
    of them have many places in all."""
    grams = [np.frombuffer(g, np.uint32) for g in table.column("grams").to_pylist()]
    many = [np.frombuffer(m, bool) for m in table.column("many").to_pylist()]
    values, index, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[index[np.concatenate(many)]] = True
    places = np.concatenate([np.frombuffer(p, np.uint16) for p in table.column("places").to_pylist()])
    hot = np.bincount(index, weights=places, minlength=len(values)) > HOT
    ends = np.cumsum([len(g) for g in grams])[:-1]
    own, hot = np.split(twice[index], ends), np.split(hot[index], ends)
    return pa.table({"block": table.column("block"), "shard": table.column("shard"),
                     "grams": _binary([g[keep] for g, keep in zip(grams, own)]),
                     "hot": _binary([x[keep] for x, keep in zip(hot, own)])})


def _known(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shared anchors as shard and low half, sorted; which of them are hot)."""
    keys = np.concatenate([(np.uint64(s) << np.uint64(32)) | np.frombuffer(g, np.uint32).astype(np.uint64)
                           for s, g in zip(notes.column("shard").to_pylist(), notes.column("grams").to_pylist())])
    hot = np.concatenate([np.frombuffer(x, bool) for x in notes.column("hot").to_pylist()])
    order = np.argsort(keys, kind="stable")
    return keys[order], hot[order]


def _own_windows(pick: np.ndarray, start, count, offset):
    """Single windows in place of the contexts `pick`: (context, start, count, offset)."""
    at = np.flatnonzero(pick)
    row = np.repeat(at, count[at])
    step = np.arange(len(row)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
    return row, start[row] + step, np.ones(len(row), np.int64), offset[row] - step


_CONTEXTS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *(
    (n, pa.binary()) for n in ("ids", "keys", "counts", "offsets", "least", "most", "contexts"))])


def _send_contexts(shards: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        release()
        rows = []
        has = notes.filter(pc.is_valid(notes.column("grams"))) if notes.num_rows else notes
        if docs.num_rows and has.num_rows:
            known, hot = _known(has)
            block, parts = _block(docs, notes), []
            for h, start, count, offset, row in block.anchors():
                if not len(known):
                    break
                mine = (_shard(h, shards).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[at] == mine
                split = hit & hot[at]
                each, *single = _own_windows(split, start, count, offset)
                hit &= ~split
                h, doc = np.r_[h[hit], h[each]], block.ids[np.r_[row[hit], row[each]]]
                start, count, offset = (np.r_[x[hit], y] for x, y in zip((start, count, offset), single))
                alone = np.r_[np.zeros(hit.sum(), bool), np.ones(len(each), bool)]
                ctx = block.contexts(start, count)
                ids = context_ids(ctx, count, offset)
                parts.append(_distinct(ids, h, np.where(alone, _shard(ids, shards), _shard(h, shards)), count, offset,
                                       doc, doc, ctx))
            if parts:
                ids, h, shard, count, offset, least, most, ctx = _distinct(*(np.concatenate(c) for c in zip(*parts)))
                label = docs.column("__block")[0].as_py()
                for s in np.unique(shard):
                    i = np.flatnonzero(shard == s)
                    n = (count[i] + LENGTH - 1)[:, None]
                    rows.append((int(s), label, ids[i].tobytes(), h[i].tobytes(), count[i].astype(np.uint8).tobytes(),
                                 offset[i].astype(np.uint8).tobytes(), least[i].tobytes(), most[i].tobytes(),
                                 ctx[i][np.arange(_WIDE) < n].tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CONTEXTS)],
                                    schema=_CONTEXTS)
    return run


def _distinct(ids, h, shard, count, offset, least, most, ctx):
    """One row per context, with the smallest and largest document."""
    _, first, index = np.unique(ids, return_index=True, return_inverse=True)
    lo, hi = least[first].copy(), most[first].copy()
    np.minimum.at(lo, index, least)
    np.maximum.at(hi, index, most)
    return ids[first], h[first], shard[first], count[first], offset[first], lo, hi, ctx[first]


def _runs(key, ctx, first, count, offset, low):
    """Runs of equal verdicts in each distinct context: (context, first and
    last window, smallest document), by context.  Contexts are sorted slice
    by slice, all those of an anchor together; an anchor with one context has
    nothing to compare."""
    by_key = np.argsort(key, kind="stable")
    k = key[by_key]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[edge, len(k)])
    alone = by_key[edge[size == 1]]
    parts = [(alone, np.zeros(len(alone), np.int64), count[alone] - 1, low[alone])]
    several = by_key[np.repeat(size > 1, size)]
    ends = np.cumsum(size[size > 1])
    a = 0
    while a < len(several):
        b = int(ends[min(np.searchsorted(ends, a + _SORTED), len(ends) - 1)])
        own = several[a:b]
        row, start, smallest = smallest_ids(key[own], ctx[first[own]], count[own], offset[own], low[own])
        at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (smallest[1:] != smallest[:-1])])
        parts.append((own[row[at]], start[at], start[np.r_[at[1:], len(row)] - 1], smallest[at]))
        a = b
    got = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(got[0], kind="stable")
    return [c[order] for c in got]


def _judge(table: pa.Table) -> pa.Table:
    """Verdicts per block: for each context, runs of windows (first, last) and
    the smallest document, where that is below the block's largest."""
    col = {n: table.column(n).to_pylist() for n in _CONTEXTS.names}
    ids = [np.frombuffer(b, _U64) for b in col["ids"]]
    count = np.concatenate([np.frombuffer(b, np.uint8) for b in col["counts"]]).astype(np.int64)
    offset = np.concatenate([np.frombuffer(b, np.uint8) for b in col["offsets"]]).astype(np.int64)
    key, least, most = (np.concatenate([np.frombuffer(b, t) for b in col[n]])
                        for n, t in (("keys", _U64), ("least", _I64), ("most", _I64)))
    ctx = np.zeros((len(key), _WIDE), np.uint8)
    ctx[np.arange(_WIDE) < (count + LENGTH - 1)[:, None]] = np.concatenate(
        [np.frombuffer(b, np.uint8) for b in col["contexts"]])
    flat = np.concatenate(ids)
    _, first, index = np.unique(flat, return_index=True, return_inverse=True)
    if not ((ctx == ctx[first[index]]).all(1) & (key == key[first[index]])).all():   # equal ids, other bytes
        first, index = np.arange(len(flat)), np.arange(len(flat))
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, index, least)
    run_row, run_from, run_to, run_doc = _runs(key[first], ctx, first, count[first], offset[first], low)
    run_first = np.searchsorted(run_row, np.arange(len(first)))
    run_count = np.bincount(run_row, minlength=len(first))
    out, base = {"block": [], "ids": [], "keys": [], "single": [], "froms": [], "tos": [], "docs": []}, 0
    for block, own in zip(col["block"], ids):
        idx = index[base:base + len(own)]
        n = run_count[idx]
        runs = np.repeat(run_first[idx] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        who = np.repeat(np.arange(len(own)), n)
        use = run_doc[runs] < most[base:base + len(own)][who]
        runs, who = runs[use], who[use]
        base += len(own)
        if len(runs):
            out["block"].append(block)
            out["ids"].append(own[who].tobytes())
            out["keys"].append(key[base - len(own):base][who].tobytes())
            out["single"].append((count[base - len(own):base][who] == 1).tobytes())
            out["froms"].append(run_from[runs].astype(np.uint8).tobytes())
            out["tos"].append(run_to[runs].astype(np.uint8).tobytes())
            out["docs"].append(run_doc[runs].tobytes())
    return pa.table(out, schema=pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in (
        "ids", "keys", "single", "froms", "tos", "docs"))]))


def _cut(as_text: bool):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        release()
        names = ["__doc", "__text", "__block"]
        out = docs.drop_columns(names)
        block = _block(docs, notes)
        total = len(block.bytes)
        change = np.zeros(total + 1, np.int32)
        has = notes.filter(pc.is_valid(notes.column("ids"))) if notes.num_rows else notes
        if docs.num_rows and has.num_rows:
            ids, froms, tos, low = (np.concatenate([np.frombuffer(b, t) for b in has.column(n).to_pylist()])
                                    for n, t in (("ids", _U64), ("froms", np.uint8), ("tos", np.uint8), ("docs", _I64)))
            keys = np.concatenate([np.frombuffer(b, _U64) for b in has.column("keys").to_pylist()])
            known = np.unique(keys)
            split = np.unique(keys[np.concatenate([np.frombuffer(b, bool) for b in has.column("single").to_pylist()])])
            order = np.argsort(ids, kind="stable")
            ids, froms, tos, low = ids[order], froms[order].astype(np.int64), tos[order].astype(np.int64), low[order]
            for h, start, count, offset, row in block.anchors():
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                start, count, offset, row = start[hit], count[hit], offset[hit], row[hit]
                # the anchor may have been split: look its windows up one by one as well
                many = split[np.minimum(np.searchsorted(split, h[hit]), len(split) - 1)] == h[hit] if len(split) else \
                    np.zeros(len(start), bool)
                each, *single = _own_windows(many, start, count, offset)
                start, count, offset = (np.r_[x, y] for x, y in zip((start, count, offset), single))
                row = np.r_[row, row[each]]
                mine = context_ids(block.contexts(start, count), count, offset)
                a, b = np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")
                n = b - a
                who = np.repeat(np.arange(len(mine)), n)
                runs = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                use = low[runs] < block.ids[row[who]]
                who, runs = who[use], runs[use]
                np.add.at(change, start[who] + froms[runs], 1)
                np.add.at(change, start[who] + tos[runs] + LENGTH, -1)
        gone = np.cumsum(change, out=change)[:total] > 0
        del change
        kept, removed, spans = [], [], []
        for i, (a, n) in enumerate(zip(block.starts, block.sizes)):
            g = gone[a:a + n]
            if block.copy[i] and n >= LENGTH:
                g = np.ones(n, bool)
            removed.append(int(g.sum()))
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
            own = block.bytes[a:a + n]
            if as_text and n and g.any():                          # a character goes if any of its bytes does
                lead = np.flatnonzero((own & 0xC0) != 0x80)
                g = np.repeat(np.logical_or.reduceat(g, lead), np.diff(np.r_[lead, n]))
            kept.append(own[~g].tobytes())
        if as_text:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        for name, col in (("__kept", pa.array(kept, pa.string() if as_text else pa.binary())),
                          ("__n_bytes", pa.array(block.sizes, pa.int64())),
                          ("__n_removed", pa.array(removed, pa.int64())), ("__n_spans", pa.array(spans, pa.int64()))):
            out = out.append_column(name, col)
        return out
    return run


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                as_text: bool = False) -> DataFrame:
    """The columns named by `keep` (all by default), `__kept` (the remaining
    bytes; with `as_text` a string without characters cut in two),
    `__n_bytes`, `__n_removed`, `__n_spans` (maximal removed runs)."""
    spark = ready(docs)
    keep = docs.columns if keep is None else keep
    blocks = block_count(docs, text_col)
    total = blocks * 8 << 20
    shards = max(shuffle_partitions(spark), math.ceil(total / 18 / SHARD_ANCHORS))
    block = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))), F.lit(blocks))
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text"),
                       block.alias("__block"))
    # texts equal to an earlier document's, by digest
    prints = stored(docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), block.alias("block"), F.octet_length(text_col).alias("size"),
        F.md5(F.col(text_col).cast("binary")).alias("digest")), "digests")
    first = stored(prints.groupBy("digest", "size").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                   .where("lo != hi"), "repeated")
    copies = stored(prints.join(first, ["digest", "size"]).where("doc != lo").select(
        "block", "doc", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("half")).distinct(), "copies")

    by_block = rows.groupBy("__block")
    anchors = by_block.cogroup(copies.groupBy("block")).applyInArrow(
        _send_anchors(shards), "shard long, block long, grams binary, many binary, places binary")
    shared = anchors.groupBy("shard").applyInArrow(_shared, "block long, shard long, grams binary, hot binary")
    none, nobody = F.lit(None).cast("binary"), [F.lit(None).cast("long").alias(c) for c in ("doc", "half")]
    notes = shared.select("block", "shard", "grams", "hot", *nobody).union(
        copies.select("block", F.lit(None).cast("long"), none, none, "doc", "half"))
    contexts = by_block.cogroup(notes.groupBy("block")).applyInArrow(
        _send_contexts(shards), ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in _CONTEXTS))
    verdicts = contexts.groupBy("shard").applyInArrow(
        _judge, "block long, ids binary, keys binary, single binary, froms binary, tos binary, docs binary")
    notes = verdicts.select("block", "ids", "keys", "single", "froms", "tos", "docs", *nobody).union(
        copies.select("block", *[none] * 6, "doc", "half"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + [f"`__kept` {'string' if as_text else 'binary'}", "`__n_bytes` bigint",
                          "`__n_removed` bigint", "`__n_spans` bigint"])
    return by_block.cogroup(notes.groupBy("block")).applyInArrow(_cut(as_text), schema)
