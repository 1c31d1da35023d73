"""Near-duplicate vectors by a robust-pruned flat graph.

1. Usable vectors (not null, not zero, only finite components) are scaled to
   unit length in double precision; equal ones become one representative
   with a count.
2. Centroids from a bounded sample (about SAMPLE vectors or ten per centroid,
   at most 10 * MAX_CENTROIDS, chosen by a hash) split the representatives into overlapping shards of about SHARD
   vectors: each goes to its OVERLAP nearest centroids.  A shard above twice
   that size (one dense cluster) is dealt to blocks, and every pair of blocks
   is a shard of its own, so no task holds an unbounded group and no pair of
   a cluster is lost.
3. Each shard builds neighbour lists (nearest candidates by blocked matrix
   products) and prunes them robustly: a candidate is dropped if a kept
   neighbour is ALPHA times closer to it than the node itself is, which
   leaves long edges that a search can travel.  Lists of one vector from
   several shards are united.
4. Every vector searches the shards it lives in, greedily from the shard's
   medoid with a beam; once inside the range the search expands over all
   neighbours within it until no new one turns up.  Found pairs are checked
   in double precision against the threshold.
5. A pair that two shards found is counted in the smaller shard only, known
   from the vectors' shard lists.  Shards return link counts per vector and a
   spanning forest, never all pairs; forests become components.

6. The audit measures recall: a bounded sample of about AUDIT vectors is
   compared with all vectors, batch by batch, for the true number of links.
   Below LEAST_RECALL the search is repeated with twice the overlap, then over
   all pairs of blocks of the whole table; if that falls short too, the call
   fails.

Defined results: unusable vectors link with nothing and are their own
component; equal rows count once; unlike vectors of one vec_id are vectors of
their own, each with its own links, in one component; a null vec_id has a null component and is kept; vectors of another
length than the most frequent one link within their own length only; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, components, lookup, ready, running, stored

THRESHOLD = 0.95
SHARD, OVERLAP = 1000, 3
SAMPLE, MAX_CENTROIDS = 20_000, 4096      # the sample: SAMPLE vectors, or ten per centroid if that is more
LEAST_RECALL = 0.9
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 48, 1.2, 32
WIDTH = 96             # edges of a node in a search: its own, and edges into it as far as they fit
AUDIT = 256
_DENSE = 0.9
_SLACK = 1e-4          # single precision searches that far below the threshold
_PAIRS = 50_000


def _split(total: int, target: int) -> int:
    return max(1, math.ceil(total / target))


# --- preparing --------------------------------------------------------------------

def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2, vec): unit vectors as bytes of doubles, null if unusable."""
    for batch in batches:
        ids, vectors = (batch.column(i).to_pylist() for i in range(2))
        k1, k2, out = [], [], []
        for i, v in zip(ids, vectors):
            x = None if i is None or not v or any(c is None for c in v) else np.asarray(v, np.float64) + 0.0
            scale = 0.0 if x is None or not np.isfinite(x).all() else float(np.abs(x).max())
            if scale == 0.0:
                k1.append(None), k2.append(None), out.append(None)
                continue
            h = xxhash.xxh3_128_intdigest(x.tobytes())
            x = x / scale
            k1.append(h >> 64)
            k2.append(h & 0xFFFFFFFFFFFFFFFF)
            out.append((x / np.sqrt(x @ x)).tobytes())
        signed = lambda c: pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in c], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), signed(k1), signed(k2),
                                          pa.array(out, pa.binary())], names=["id", "k1", "k2", "vec"])


def _centroids(sample: np.ndarray, k: int, threshold: float, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample, which holds about ten vectors per centroid or more.

    A dense cluster, whose points lie within the range of each other, must
    not be shared out among more centroids than a vector goes to: of dense
    centroids closer than twice the range only one stays, and its cell is
    dealt to blocks instead."""
    k = min(k, len(sample))
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    spread = np.ones(k)                                            # mean similarity of a centroid's points to it
    for _ in range(rounds):
        own = np.concatenate([(sample[i:i + 2048] @ c.T).argmax(1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm, count = np.linalg.norm(total, axis=1), np.bincount(own, minlength=k)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], c)
        spread = np.where(count > 0, norm / np.maximum(count, 1), 0.0)
    kept, twice = [], 2 * threshold ** 2 - 1
    for i in np.argsort(-spread, kind="stable"):
        if spread[i] == 0.0 and kept:
            continue
        dense = [j for j in kept if spread[j] >= _DENSE] if spread[i] >= _DENSE else []
        if not dense or (c[dense] @ c[i]).max() < twice:
            kept.append(i)
    return c[kept]


def _assign(held, width: int, overlap: int):
    """(id, mult, vec, cell): each vector at its nearest centroids; a vector
    of another length in the cell of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        for batch in batches:
            vec = batch.column(2)
            size = np.array([len(v) for v in vec.to_pylist()], np.int64) // 8
            index, cells = [], []
            main = np.flatnonzero(size == width)
            if len(main):
                x = np.frombuffer(b"".join(vec.take(pa.array(main)).to_pylist())).reshape(-1, width)
                near = np.argsort(-(x.astype(np.float32) @ centroids.T), axis=1, kind="stable")[:, :overlap]
                index.append(np.repeat(main, near.shape[1]))
                cells.append(near.ravel())
            other = np.flatnonzero(size != width)
            index.append(other)
            cells.append(-size[other])
            index, cells = np.concatenate(index), np.concatenate(cells)
            for a in range(0, len(index), 20_000):
                rows = batch.take(pa.array(index[a:a + 20_000]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells[a:a + 20_000].astype(np.int64))],
                                                 names=["id", "mult", "vec", "cell"])
    return run


# --- the graph ----------------------------------------------------------------------

def prune(x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """(n, degree) kept neighbours, -1 where fewer: nearest first, without
    candidates that a kept neighbour covers."""
    out = np.full((len(candidates), degree), -1, np.int64)
    for a in range(0, len(candidates), 256):
        c = candidates[a:a + 256]
        own = np.arange(a, a + len(c))
        v = x[c]
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nkd,nd->nk", v, x[own])))
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nkd,nld->nkl", v, v)))
        alive = c != own[:, None]
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        rows = np.arange(len(c))
        for r in range(degree):
            has = alive.any(1)
            if not has.any():
                break
            best = alive.argmax(1)
            out[own[has], r] = c[rows, best][has]
            alive &= ~(has[:, None] & (alpha * between[rows, best] <= d))
            alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, seed: int) -> np.ndarray:
    """Neighbour lists (n, DEGREE) of one shard's vectors."""
    n = len(x)
    k = min(CANDIDATES, n)
    near = np.empty((n, k), np.int64)
    for a in range(0, n, 512):
        s = x[a:a + 512] @ x.T
        near[a:a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(seed).integers(0, n, (n, 8))       # long edges between clusters
    return prune(x, np.concatenate([near, far], 1))


def both_ways(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Padded lists (-1) of a graph whose edges serve both ways: a node's own
    edges first, then edges into it, WIDTH in all."""
    back = np.r_[np.zeros(len(src), np.int64), np.ones(len(src), np.int64)]
    src, dst = np.r_[src, dst], np.r_[dst, src]
    order = np.lexsort((dst, back, src))
    src, dst = src[order], dst[order]
    degree = np.bincount(src, minlength=n)
    place = np.arange(len(src)) - np.repeat(np.cumsum(degree) - degree, degree)
    use = place < WIDTH
    lists = np.full((n, max(1, min(WIDTH, int(degree.max()) if n else 1))), -1, np.int64)
    lists[src[use], place[use]] = dst[use]
    return lists


def medoids(x: np.ndarray, n: int = 8) -> np.ndarray:
    """The vector nearest the mean, and those nearest the means of n - 1 slices."""
    parts = [x, *np.array_split(x, min(n - 1, len(x)))]
    return np.unique([int((x @ p.mean(0)).argmax()) for p in parts])


def range_search(x: np.ndarray, lists: np.ndarray, entries: np.ndarray, least: float) -> np.ndarray:
    """Boolean (n, n): for every vector as query, the vectors with similarity
    >= least that a beam search from the entries (and its own list) reaches
    and that expanding over neighbours within the range adds."""
    n = len(x)
    seen, inside = np.zeros((n, n), bool), np.zeros((n, n), bool)
    rows = np.arange(n)
    start = np.concatenate([np.tile(entries, (n, 1)), rows[:, None]], 1)
    beam, sim = start, np.einsum("nkd,nd->nk", x[start], x)
    seen[rows[:, None], start] = True
    done = np.zeros(beam.shape, bool)
    for _ in range(4 * BEAM):
        open_ = np.where(done, -2.0, sim)
        best = open_.argmax(1)
        go = np.flatnonzero(open_[rows, best] > -2.0)
        if not len(go):
            break
        done[go, best[go]] = True
        more = lists[beam[go, best[go]]]
        fresh = (more >= 0) & ~seen[go[:, None], more]
        s = np.where(fresh, np.einsum("nkd,nd->nk", x[more], x[go]), -3.0)
        q, j = np.nonzero(fresh)
        seen[go[q], more[q, j]] = True
        inside[go[q], more[q, j]] |= s[q, j] >= least
        grown = np.full((n, more.shape[1]), -1), np.full((n, more.shape[1]), -3.0, x.dtype)
        grown[0][go], grown[1][go] = more, s
        beam, sim = np.concatenate([beam, grown[0]], 1), np.concatenate([sim, grown[1]], 1)
        done = np.concatenate([done, grown[1] <= -2.0], 1)
        if beam.shape[1] > BEAM:
            top = np.argpartition(-sim, BEAM - 1, axis=1)[:, :BEAM]
            beam, sim, done = (np.take_along_axis(m, top, 1) for m in (beam, sim, done))
    inside[rows[:, None], start] |= np.einsum("nkd,nd->nk", x[start], x) >= least
    np.fill_diagonal(inside, False)
    q, node = np.nonzero(inside)
    while len(q):                                                   # expand inside the range
        near = np.zeros((n, n), bool)
        for a in range(0, len(q), _PAIRS):
            more = lists[node[a:a + _PAIRS]]
            ok = more >= 0
            near[np.broadcast_to(q[a:a + _PAIRS, None], more.shape)[ok], more[ok]] = True
        near &= ~seen
        seen |= near
        q, node = np.nonzero(near)
        ok = np.zeros(len(q), bool)
        for a in range(0, len(q), _PAIRS):
            c = slice(a, a + _PAIRS)
            ok[c] = np.einsum("nd,nd->n", x[q[c]], x[node[c]]) >= least
        q, node = q[ok], node[ok]
        inside[q, node] = True
    return inside | inside.T


# --- the passes ----------------------------------------------------------------------

def _vectors(table: pa.Table, dtype=np.float64) -> np.ndarray:
    vec = table.column("vec").to_pylist()
    return np.frombuffer(b"".join(vec)).reshape(len(vec), -1).astype(dtype)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    lists = build_graph(_vectors(table, np.float32), int(table.column("shard")[0].as_py()) & 0xFFFF)
    return pa.table({"id": pa.array(ids, pa.int64()),
                     "next": pa.array([ids[row[row >= 0]].tolist() for row in lists], pa.list_(pa.int64()))})


def _links(threshold: float):
    """Per shard: link counts (a = id, b null, n) and forest edges (a, b)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        shard = table.column("shard")[0].as_py()
        ids, mult = table.column("id").to_numpy(), table.column("mult").to_numpy()
        exact = _vectors(table)
        x = exact.astype(np.float32)
        n = len(ids)
        flat = table.column("next").combine_chunks()
        size = np.diff(flat.offsets.to_numpy())
        dst = flat.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, dst), n - 1)
        own = ids[at] == dst                                       # neighbours from other shards are not here
        lists = both_ways(np.repeat(np.arange(n), size)[own], at[own], n)
        inside = range_search(x, lists, medoids(x), threshold - _SLACK)
        a, b = np.nonzero(np.triu(inside, 1))
        ok = np.concatenate([np.einsum("nd,nd->n", exact[a[i:i + _PAIRS]], exact[b[i:i + _PAIRS]]) >= threshold
                             for i in range(0, len(a), _PAIRS)]) if len(a) else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        uf, edges = UnionFind(), []
        for i, j in zip(a.tolist(), b.tolist()):
            if uf.find(i) != uf.find(j):
                uf.union(i, j)
                edges.append((int(ids[i]), int(ids[j])))
        # a pair is counted in the smallest shard that holds both
        where = table.column("shards").combine_chunks()
        many = np.diff(where.offsets.to_numpy())
        held = np.full((n, int(many.max())), -1, np.int64)
        held[np.repeat(np.arange(n), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = \
            where.flatten().to_numpy()
        held[held >= shard] = -1                                   # only smaller shards matter
        first = np.ones(len(a), bool)
        for c in range(held.shape[1]):
            for e in range(held.shape[1]):
                first &= ~((held[a, c] == held[b, e]) & (held[a, c] != -1))
        count = np.zeros(n, np.int64)
        np.add.at(count, a[first], mult[b[first]])
        np.add.at(count, b[first], mult[a[first]])
        some = count > 0
        return pa.table({"a": pa.array([*ids[some].tolist(), *(p for p, _ in edges)], pa.int64()),
                         "b": pa.array([None] * int(some.sum()) + [q for _, q in edges], pa.int64()),
                         "n": pa.array([*count[some].tolist(), *[0] * len(edges)], pa.int64())})
    return run


def _audit(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = held.value
        for batch in batches:
            own, mult = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            vec = batch.column(2).to_pylist()
            rows = [i for i, v in enumerate(vec) if len(v) == queries.shape[1] * 8]
            if not rows:
                continue
            x = np.frombuffer(b"".join(vec[i] for i in rows)).reshape(len(rows), -1)
            hit = (queries @ x.T >= threshold) & (ids[:, None] != own[rows][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ mult[rows])],
                                             names=["id", "n"])
    return run


def _sample(reps: DataFrame, width: int, size: int, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of about `size` vectors of the main length, chosen by a hash of their number."""
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 62)) < int(min(1.0, size / max(1, total)) * (1 << 62))
    got = reps.where((F.length("vec") == 8 * width) & share).select("id", "vec").orderBy("id").collect()
    return (np.array([r["id"] for r in got], np.int64),
            np.frombuffer(b"".join(r["vec"] for r in got)).reshape(-1, width))


def _search(reps: DataFrame, width: int, k: int, overlap: int, shard: int, threshold: float, total: int) -> DataFrame:
    """Link counts (a, null, n) and forest edges (a, b) of the graph search
    over `k` cells, each vector in its `overlap` nearest.  One cell is the
    way that leaves no pair out: every pair of its blocks is a shard."""
    spark = reps.sparkSession
    sample = _sample(reps, width, max(SAMPLE, 10 * k), total, 5)[1].astype(np.float32)
    if not len(sample):
        sample = np.ones((1, width), np.float32)
    held = spark.sparkContext.broadcast(_centroids(sample, k, threshold))
    cells = reps.mapInArrow(_assign(held, width, overlap), "id long, mult long, vec binary, cell long")
    cells = stored(cells, "cells")

    # shards: a cell, or a pair of blocks of an oversized cell
    size = cells.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("m")).select(
        "cell", F.when(F.col("m") > 2, F.col("m")).otherwise(1).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks"))
    members = (cells.join(size, "cell").withColumn("block", block)
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .select("id", "mult", "vec", ((F.col("cell") + (1 << 20)) * (1 << 40) + F.least("block", "other") * (1 << 20)
                                             + F.greatest("block", "other")).alias("shard")))
    graph = (members.groupBy("shard").applyInArrow(_build, "id long, next array<long>")
             .groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")))
    where = members.groupBy("id").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    return stored(members.join(graph, "id").join(where, "id").groupBy("shard").applyInArrow(
        _links(threshold), "a long, b long, n long"), "found")


def _recall(reps: DataFrame, counts: DataFrame, asked: tuple[np.ndarray, np.ndarray], threshold: float) -> float:
    """The share of the audited vectors' links that were counted; the true
    links come from comparing them with every vector."""
    held = reps.sparkSession.sparkContext.broadcast(asked)
    true = reps.mapInArrow(_audit(held, threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("true"))
    seen = true.join(counts, "id", "left").agg(
        F.sum(F.least(F.coalesce("n", F.lit(0)), "true")).alias("found"), F.sum("true").alias("true")).head()
    return seen["found"] / seen["true"] if seen["true"] else 1.0


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, shard: int = SHARD, overlap: int = OVERLAP,
                    audit: int = AUDIT) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, audit_recall (the
    share of the audited sample's links that were found, in every row)."""
    spark = ready(vectors)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(src.mapInArrow(_usable, "id long, k1 long, k2 long, vec binary"), "vectors")
    usable = rows.where("vec is not null")
    # a class holds equal vectors; classes are numbered in the order of their smallest id
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count_distinct("id").alias("mult"))
    classes = stored(running(classes, [F.col(c) for c in ("first", "k1", "k2")], "id", {}), "classes")
    reps = stored(usable.withColumnRenamed("id", "first").join(classes, ["k1", "k2", "first"])
                  .select("id", "mult", "vec").dropDuplicates(["id"]), "reps")

    total = reps.count()
    lengths = reps.groupBy(F.length("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = lengths[0]["w"] // 8 if lengths else 1
    asked = _sample(reps, width, audit, total, 9) if audit else None
    cells = min(_split(total * overlap, shard), MAX_CENTROIDS)
    for k, near in ((cells, overlap), (cells, 2 * overlap), (1, 1)):
        found = _search(reps, width, k, near, shard, threshold, total)
        counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        recall = _recall(reps, counts, asked, threshold) if audit else None
        if recall is None or recall >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"audited recall {recall:.3f} is below {LEAST_RECALL}, with every vector compared with all blocks")

    # classes that share an id are joined, whether or not their vectors link
    several = usable.groupBy("id").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("k1", "k2") for f in (F.min, F.max)]).where(
        "k1_min <> k1_max or k2_min <> k2_max").select("id")
    shared = stored(usable.join(several, "id").select(F.col("id").alias("of"), "k1", "k2").distinct()
                    .join(classes.select("id", "k1", "k2"), ["k1", "k2"]).select("of", F.col("id").alias("b")), "shared")
    shared = shared.join(shared.groupBy("of").agg(F.min("b").alias("a")), "of").select("a", "b")
    comp = components(found.where("b is not null").select("a", "b").union(shared), "a", "b").withColumnRenamed("node", "id")
    judged = classes.join(counts, "id", "left").join(comp, "id", "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("root"))
    roots = classes.select(F.col("id").alias("root"), F.col("first").alias("component_id"))
    judged = lookup(stored(judged, "judged"), roots, ["root"]).drop("root")

    out = rows.select("id", "k1", "k2").join(judged, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
                      F.lit(recall).cast("double").alias("audit_recall"))
