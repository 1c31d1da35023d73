"""Near-duplicate documents by SuperMinHash signatures.

1. A pass turns every whole text into its set of distinct word shingles and
   a SuperMinHash signature: each element has a random permutation of the
   slots, its rank j in the permutation plus a random fraction competes in
   slot p(j), so the slots of one element are correlated and the estimate
   varies less than with independent hashes.  Elements advance rank by rank
   together; a document stops as soon as all its slots are filled, because
   no later rank can be smaller.
2. Documents with equal sets form a class, and only the class's smallest
   doc_id goes on.  Signatures are cut into bands; documents that agree on a
   band meet in a bucket.
3. Buckets link to a centre and not pair by pair: every member is compared
   with the bucket's smallest id, on the full sets:
   100 * intersection >= percent * union.  Documents of buckets that still
   hold several components are compared within their family (buckets that
   share documents), block against block of bounded size, by products of
   0/1 matrices; a task returns at most one link per component it joins, so
   no pair that the bands propose is lost and no pairs are emitted.
4. Verified links become components with union-find (`common.components`).

With 28 bands of 4 slots a pair at similarity 0.8 shares no band with
probability (1 - 0.8^4)^28 = 4e-7.  Shingles are held as 64-bit hashes.

Cost beyond links: a family whose texts stay unlinked (similarity somewhat
below the threshold) is multiplied out block by block, so its arithmetic
grows with the square of the family; rows moved grow by one copy of a
document's set for every FAMILY_BLOCK documents of its family.

Defined results: null or empty text or no words give the empty set, linked
with nothing; fewer words than the shingle width make one shingle; a null
doc_id has a null component and is kept; rows that share a doc_id are one
node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (UnionFind, columns_of, components, hash_words, in_slices, lookup, mix, ready, release, salt, shingle_set, stored,
                     words_of)

BANDS, ROWS = 28, 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ELEMENTS = 200_000
FAMILY_BLOCK = 768
_COLUMNS = 4096


def superminhash(x: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of the element hashes `x` owned by documents
    `owner`; each value holds (rank j, 56-bit fraction)."""
    sig = np.full(n_docs * m, _NONE, np.uint64)
    perm = None
    for j in range(m):
        r = mix(x + salt(2 * j))
        k = j + ((mix(x ^ salt(2 * j + 1)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, owner * m + slot, np.uint64(j << 56) | (r >> np.uint64(8)))
        going = (sig.reshape(n_docs, m) == _NONE).any(1)[owner]
        if not going.any():
            break
        if perm is None:
            x, owner, k = x[going], owner[going], k[going]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
            perm[np.arange(len(x)), k] = 0
        elif not going.all():
            x, owner, perm = x[going], owner[going], perm[going]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    h = np.tile(np.array([salt(i) for i in range(bands)], np.uint64), (len(sig), 1))
    for i in range(rows):
        h = mix(h ^ parts[:, :, i]) + salt(i)
    return h


_SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                     ("bands", pa.list_(pa.int64()))])


def _signatures(width: int, bands: int, rows: int):
    def emit(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = np.empty((0, bands), np.int64)
        if full:
            x = np.concatenate([sets[i] for i in full])
            owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
            keys = band_keys(superminhash(x, owner, len(full), bands * rows), bands, rows).view(np.int64)
        at = np.cumsum([0] + [bands * bool(len(s)) for s in sets])
        h = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        half = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            half([v >> 64 for v in h]), half([v & 0xFFFFFFFFFFFFFFFF for v in h]),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel()))], schema=_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, sets, size = [], [], 0
            for doc, text in zip(*columns_of(batch, "id", "text")):
                s = shingle_set(hash_words(words_of(text)), width)
                if ids and size + len(s) > _ELEMENTS:
                    yield emit(ids, sets)
                    ids, sets, size = [], [], 0
                ids.append(doc)
                sets.append(s)
                size += len(s)
            if ids:
                yield emit(ids, sets)
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, texts = columns_of(batch, "id", "text")
            sets = [shingle_set(hash_words(words_of(t)), width) for t in texts]
            at = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            h = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array(np.array([v >> 64 for v in h], np.uint64).view(np.int64)),
                pa.array(np.array([v & 0xFFFFFFFFFFFFFFFF for v in h], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["id", "k1", "k2", "shingles"])
    return run


_CLASS = ["id", "k1", "k2"]          # a document's id and its set; rows that share an id may hold several


def _named(df: DataFrame, side: str, *more: str) -> DataFrame:
    """The class columns (and `more`) with `side` behind their names."""
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in (*_CLASS, *more)])


def _verify(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate classes (.._a, .._b), the ids of those whose full sets
    are similar enough.  A centre of very many candidates is sent to them."""
    inter = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    both = lookup(stored(edges, "candidates"), _named(sets, "a", "shingles"), [f"{c}_a" for c in _CLASS]).join(
        _named(sets, "b", "shingles"), [f"{c}_b" for c in _CLASS])
    return (both.withColumn("inter", inter)
            .where(F.col("inter") * 100 >= percent * (F.size("shingles_a").cast("long") + F.size("shingles_b") - F.col("inter")))
            .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members (bucket, id, ...) with `c`, the component so far."""
    return (members.join(comp.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("c", F.coalesce("component_id", "id")).drop("component_id"))


def _links_between(percent: int):
    """Links that join different components among the documents of two blocks
    of a family (or one block with itself), from exact intersection sizes."""
    def run(table: pa.Table) -> pa.Table:
        release()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        ids, comp, block = (table.column(n).to_numpy() for n in ("id", "c", "block"))
        lists = table.column("shingles").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), size)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        out_a, out_b = [], []
        if len(np.unique(comp)) > 1 and len(left) and len(right):
            _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
            common = df[column] > 1
            fit = np.bincount(row[common], minlength=len(ids)) * 100 >= percent * size   # else no partner can do
            column = (np.cumsum(df > 1) - 1)[column]
            use = common & fit[row]
            row, column = row[use], column[use]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            left, right = left[fit[left]], right[fit[right]]
            place = np.full((2, len(ids)), -1)
            place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
            inter = np.zeros((len(left), len(right)), np.float32)
            edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + _COLUMNS, _COLUMNS))
            for at, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                sides = []
                for side, n in ((0, len(left)), (1, len(right))):
                    m = np.zeros((n, _COLUMNS), np.float32)
                    to = place[side, row[x:y]]
                    m[to[to >= 0], column[x:y][to >= 0] - at * _COLUMNS] = 1
                    sides.append(m)
                inter += sides[0] @ sides[1].T
            inter = inter.astype(np.int64)   # whole numbers below 2^24, exact in single precision
            total = size[left][:, None].astype(np.int64) + size[right][None, :]
            near = (inter * (100 + percent) >= percent * total) & (comp[left][:, None] != comp[right][None, :])
            uf = UnionFind()
            for i, j in zip(*np.nonzero(near)):
                x, y = int(comp[left[i]]), int(comp[right[j]])
                if uf.find(x) != uf.find(y):
                    uf.union(x, y)
                    out_a.append(ids[left[i]])
                    out_b.append(ids[right[j]])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
    return run


def _compare_families(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of `apart` (bucket, id, centre, c) that no
    centre has joined.  Buckets that share documents form a family; a family
    is dealt to blocks of about FAMILY_BLOCK documents, and every pair of
    blocks is one task, which returns links and no pairs."""
    family = components(apart.select("id", "centre"), "id", "centre").select(
        F.col("node").alias("id"), F.col("component_id").alias("family"))
    ids = apart.select(*_CLASS, "c").distinct().join(family, "id")
    count = ids.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks"))
    ids = ids.join(count, "family").withColumn(
        "block", F.pmod(F.xxhash64(*_CLASS, F.lit(11)), F.col("blocks")).cast("int"))
    ids = ids.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (ids.join(sets, _CLASS).select("family", F.least("block", "other").alias("p"),
                                        F.greatest("block", "other").alias("q"), "block", "id", "c", "shingles")
            .groupBy("family", "p", "q").applyInArrow(_links_between(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    ready(docs)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = stored(src.mapInArrow(_signatures(width, bands, rows),
                                "id long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    linked = sig.where("id is not null and n > 0")
    classes = stored(linked.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")
    reps = stored(linked.join(classes.select("k1", "k2", F.col("rep").alias("id")), _CLASS)
                  .select(*_CLASS, "n", F.explode(F.array_distinct("bands")).alias("bucket")).distinct(), "bands")
    centre = reps.groupBy("bucket").agg(F.min(F.struct(*_CLASS)).alias("m"), F.max(F.struct(*_CLASS)).alias("top")).where("m != top")
    members = stored(lookup(reps, stored(centre.select("bucket", "m"), "centres"), ["bucket"]).where("m is not null").select(
        "bucket", *_CLASS, "n", F.col("m.id").alias("centre"), F.col("m.k1").alias("c1"), F.col("m.k2").alias("c2")), "buckets")

    nodes = members.select(*_CLASS).distinct()
    sets = stored(src.join(nodes.select("id").distinct(), "id", "left_semi")
                  .mapInArrow(_sets(width), "id long, k1 long, k2 long, shingles array<long>")
                  .join(nodes, _CLASS, "left_semi").dropDuplicates(_CLASS), "sets")

    fits = F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")
    size = _named(sets.select(*_CLASS, F.size("shingles").cast("long").alias("n")), "a", "n")
    first = members.where("id != centre").select(
        F.col("centre").alias("id_a"), F.col("c1").alias("k1_a"), F.col("c2").alias("k2_a"),
        F.col("id").alias("id_b"), F.col("k1").alias("k1_b"), F.col("k2").alias("k2_b"), F.col("n").alias("n_b")).distinct()
    first = lookup(stored(first, "first"), size, ["id_a", "k1_a", "k2_a"]).where(fits).drop("n_a", "n_b")
    # rows that share an id are one node: the classes that hold them are linked
    held = linked.select(*_CLASS).distinct().join(classes, ["k1", "k2"])
    shared = held.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a != top").select("id", "a")
    shared = held.join(shared, "id").where("rep != a").select("a", F.col("rep").alias("b"))
    links = stored(_verify(first, sets, percent).union(shared), "links")
    comp = components(links, "a", "b")

    # buckets that still hold several components: their documents, family by family
    lab = _labelled(members, comp)
    split = lab.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    apart = stored(lab.join(split.select("bucket"), "bucket", "left_semi").select("bucket", *_CLASS, "centre", "c"), "apart")
    if not apart.isEmpty():
        rest = _compare_families(apart, sets, percent)
        links = stored(links.union(rest), "links")
        comp = components(links, "a", "b")

    by_class = (classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                .select("k1", "k2", F.coalesce("component_id", "rep").alias("component_id")))
    got = sig.join(by_class, ["k1", "k2"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))
