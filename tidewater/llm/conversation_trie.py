"""The trie of conversation prefixes, by burst tries.

A node is a distinct sequence of first turns (role and text); its members are
the conversations that begin with it.

1. Turns are numbered and every turn's prefix gets a 128-bit id: the XOR of
   hashes of (depth, turn) over the prefix, with turns told apart by digests.
   Running values are taken chunk by chunk, with one row per chunk for what
   lies before it, so that a conversation of any length is shared by many tasks.
2. Conversations with the same whole sequence are one class, whose smallest
   id stands for it with a weight; copies, however many, go no further.
3. Burst tries.  All classes begin in one suffix container under the root.  A
   container of more than `container_rows` turns, and more than one class, is
   burst by its next turn ids: one turn below the root, then as many turns
   more as the head is deep, so that a long common beginning takes few rounds.
   Nodes above the burst are trie heads; what comes below is dealt to the new
   heads' containers.  Classes that end above are finished.
4. Containers lie sorted in shards (partitions), many to a shard; each is sorted
   and swept once, common prefixes of neighbours giving the nodes.  A container
   of one class is a chain and needs no sweep, whatever its length.
5. Head nodes get their sums over subtrees from the classes below: each node's
   own value is noted with its smallest member, whose values are summed up from
   below and added over the members of a head.

The digest of the members that end at a node runs through their ids in order;
a class's ids stream through one task, in bounded memory.

Defined results: null role or text is empty; turns with equal numbers are
ordered by role and text, null numbers first; repeated turns all count; rows
without a conv_id are no conversation and are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, ready, stored

CONTAINER_ROWS = 4096
#: positions that a running value covers in one window group: 2^CHUNK_BITS
CHUNK_BITS = 12
LENDERS, SHARED = 5, 9
_NOTHING = hashlib.sha256(b"").hexdigest()
_BEFORE_ALL = -(1 << 62)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def upto(rows: DataFrame, key: str, at: str, values: dict[str, tuple]) -> DataFrame:
    """`rows` with running values (this row included) in the order of the long
    column `at` within `key`; values: name -> (aggregate, joining function, column)."""
    rows = rows.withColumn("__chunk", F.shiftright(at, CHUNK_BITS))
    ahead = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(key, "__chunk").agg(*[agg(c).alias(n) for n, (agg, _, c) in values.items()])
    per = per.select(key, "__chunk", *[F.coalesce(agg(n).over(ahead), F.lit(0)).alias(f"__{n}")
                                       for n, (agg, _, _) in values.items()])
    inside = Window.partitionBy(key, "__chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(per, [key, "__chunk"]).select(*[c for c in rows.columns if c != "__chunk"], *[
        both(F.col(f"__{n}"), agg(c).over(inside)).alias(n) for n, (agg, both, c) in values.items()])


# --- conversations -------------------------------------------------------------

def rebuilt(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, length) of every conversation, and its turns (conv, depth, digest,
    n_bytes): the first h turns of its lender (the conversation at the
    multiple of LENDERS towards zero), then its own from the h-th on, where
    h = crc32 of its decimal id modulo SHARED."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(_BEFORE_ALL)))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = stored(rows.groupBy("conv", "chunk").agg(F.count("*").alias("n")), "chunks")
    convs = chunks.groupBy("conv").agg(F.sum("n").alias("n")).withColumn(
        "h", F.crc32(F.col("conv").cast("string")) % SHARED).withColumn("lender", F.col("conv") - F.col("conv") % LENDERS)
    lent = F.least("h", F.coalesce("n_lender", F.lit(0)))
    convs = stored(convs.join(convs.select(F.col("conv").alias("lender"), F.col("n").alias("n_lender")), "lender", "left")
                   .select("conv", "lender", "h", lent.alias("lent"),
                           (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    chunks = chunks.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(convs, "conv").select(
        "conv", "chunk", "before", "h", "lent")
    inside = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = stored(rows.join(chunks, ["conv", "chunk"]).select(
        "conv", "h", "lent", (F.col("before") + F.row_number().over(inside)).alias("place"),
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes")), "turns")
    own = rows.where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "digest", "n_bytes")
    first = rows.where((F.col("conv") % LENDERS == 0) & (F.col("place") < SHARED)).select(
        F.col("conv").alias("lender"), F.col("place").alias("depth"), "digest", "n_bytes")
    lent_rows = first.join(convs.select("conv", "lender", "h"), "lender").where("depth <= h").select(*own.columns)
    return convs.select("conv", "length"), own.unionByName(lent_rows)


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by whole sequence and conversation, one row per class:
    its smallest conversation, its size and the digest of its ids in order."""
    names = ["conv", "weight", "length", "w1", "w2", "total", "ends"]
    key, first, n, digest = None, None, 0, None

    def done(out):
        if key is not None:
            out.append((first, n, *key, digest.hexdigest()))
    for batch in batches:
        out = []
        for conv, length, w1, w2, total in zip(*[c.to_pylist() for c in batch.columns]):
            if (length, w1, w2, total) == key:
                digest.update(b",%d" % conv)
                n += 1
            else:
                done(out)
                key, first, n, digest = (length, w1, w2, total), conv, 1, hashlib.sha256(b"%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    out = []
    done(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)


def classes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv (smallest member), weight, length, total (bytes), ends (digest of
    the members' ids); one row per distinct whole sequence."""
    whole = turns.groupBy("conv").agg(F.bit_xor("x1").alias("w1"), F.bit_xor("x2").alias("w2"), F.sum("n_bytes").alias("total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = convs.join(whole, "conv", "left").select("conv", "length", none("w1"), none("w2"), none("total"))
    order = ["length", "w1", "w2", "total"]
    return rows.repartition(*order).sortWithinPartitions(*order, "conv").mapInArrow(
        _class_rows, "conv long, weight long, length long, w1 long, w2 long, total long, ends string").drop("w1", "w2")


# --- containers -------------------------------------------------------------------

def burst(paths: DataFrame, container_rows: int) -> DataFrame:
    """conv, head (the depth of its container's head; length + 1 where the
    class ends above every container), classes (in the container), c1, c2 (id of the head)."""
    settled, depth, going = [], 0, None
    while True:
        at = paths.where(F.col("depth") == depth).select("conv", "length", "p1", "p2")
        at = stored(at if going is None else at.join(going, "conv", "left_semi"), "open")
        sizes = stored(at.groupBy("p1", "p2").agg(F.sum(F.col("length") - depth + 1).alias("size"), F.count("*").alias("classes")), "sizes")
        at = stored(lookup(at, sizes, ["p1", "p2"]).withColumn(
            "big", (F.col("size") > container_rows) & (F.col("classes") > 1)), "sized")
        deeper = max(1, 2 * depth)
        settled += [at.where("not big").select("conv", F.lit(depth).cast("long").alias("head"), "classes", F.col("p1").alias("c1"), F.col("p2").alias("c2")),
                    at.where(F.col("big") & (F.col("length") < deeper)).select(
                        "conv", (F.col("length") + 1).alias("head"), F.lit(0).cast("long").alias("classes"), F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"))]
        going = at.where(F.col("big") & (F.col("length") >= deeper)).select("conv")
        depth = deeper
        if going.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return stored(out, "heads")


_NODES = pa.schema([(c, pa.int64()) for c in ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "end")]
                   + [("top", pa.bool_())])
_NODE_TYPES = "conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, end long, top boolean"


def sweep(sequences: list[tuple[list, list[int], int, int]], head: int) -> list[tuple]:
    """The nodes of a container from its classes (prefix ids from the head on,
    bytes of the turns, smallest member, weight), which are sorted here."""
    nodes, path, before = [], [], []          # a node: [conv, depth, parent, n_convs, children, leaves, saved, end, bytes]

    def close(to: int):
        while len(path) > to:
            node = nodes[path.pop()]
            node[5] += not node[4]
            node[6] += (node[3] - 1) * node[8]
            if path:
                above = nodes[path[-1]]
                above[0] = min(above[0], node[0])
                above[3] += node[3]
                above[4] += 1
                above[5] += node[5]
                above[6] += node[6]
    for ids, sizes, conv, weight in sorted(sequences, key=lambda s: s[0]):
        common, most = 0, min(len(ids), len(before))
        while common < most and ids[common] == before[common]:
            common += 1
        close(common)
        for i in range(common, len(ids)):
            nodes.append([conv, head + i, path[-1] if path else None, 0, 0, 0, 0, None, sizes[i]])
            path.append(len(nodes) - 1)
        last = nodes[path[-1]]
        last[0], last[3], last[7] = min(last[0], conv), last[3] + weight, conv
        before = ids
    close(0)
    return [(conv, depth, None if up is None else nodes[up][0], n, kids, leaves, saved, end, up is None)
            for conv, depth, up, n, kids, leaves, saved, end, _ in nodes]


def _sweep_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers one after the other; rows come sorted by container, class and depth."""
    def out(held):
        sequences = []
        for conv, _, p1, p2, n_bytes, weight in held:
            if not sequences or sequences[-1][2] != conv:
                sequences.append(([], [], conv, weight))
            sequences[-1][0].append((p1, p2))
            sequences[-1][1].append(n_bytes)
        nodes = sweep(sequences, held[0][1])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), _NODES)], schema=_NODES)
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for container, row in zip(zip(*columns[:3]), zip(*columns[3:])):
            if container != key and held:
                yield out(held)
                held = []
            key = container
            held.append(row)
    if held:
        yield out(held)


# --- the trie ----------------------------------------------------------------------

def trie(turns: DataFrame, *, container_rows: int = CONTAINER_ROWS, **columns: str) -> DataFrame:
    """One row per node of the rebuilt conversations' trie: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ready(turns)
    convs, rows = rebuilt(turns, **columns)
    rows = stored(rows.select("conv", "depth", "n_bytes", F.xxhash64(F.lit(1), "depth", "digest").alias("x1"),
                              F.xxhash64(F.lit(2), "depth", "digest").alias("x2")), "rebuilt")
    classes = stored(classes_of(convs, rows), "classes")
    kept = lookup(rows, classes.drop("ends"), ["conv"]).where("weight is not null")
    below = upto(kept, "conv", "depth", {"p1": (F.bit_xor, _xor, "x1"), "p2": (F.bit_xor, _xor, "x2"), "bytes": (F.sum, _sum, "n_bytes")})
    zero = F.lit(0).cast("long")
    names = ["conv", "depth", "p1", "p2", "up1", "up2", "n_bytes", "bytes", "total", "weight", "length"]
    paths = below.withColumns({"up1": _xor(F.col("p1"), F.col("x1")), "up2": _xor(F.col("p2"), F.col("x2"))}).select(*names)
    roots = classes.select("conv", "total", "weight", "length", *[zero.alias(c) for c in ("depth", "p1", "p2", "up1", "up2", "n_bytes", "bytes")])
    paths = stored(paths.unionByName(roots.select(*names)), "paths")
    heads = burst(paths, container_rows)
    paths = stored(lookup(paths, heads, ["conv"]), "placed")

    # containers: swept, or chains
    inside = paths.where("depth >= head")
    order = ["c1", "c2", "head"]
    swept = stored(inside.where("classes > 1").select(*order, "conv", "depth", "p1", "p2", "n_bytes", "weight")
                   .repartition(*order).sortWithinPartitions(*order, "conv", "depth").mapInArrow(_sweep_shard, _NODE_TYPES), "swept")
    ends = F.when(F.col("depth") == F.col("length"), F.col("conv"))
    chain = inside.where("classes = 1").select(
        "conv", "depth", F.col("conv").alias("parent_conv"), F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("total") - F.col("bytes") + F.col("n_bytes"))).alias("saved"), ends.alias("end"),
        (F.col("depth") == F.col("head")).alias("top"))
    contained = swept.unionByName(chain)
    tops = contained.where("top").drop("parent_conv", "top")

    # heads: nodes above the containers
    above = paths.where("depth < head")
    nodes = stored(above.groupBy("depth", "p1", "p2").agg(
        F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("up1").alias("up1"),
        F.min("up2").alias("up2"), F.max(ends).alias("end")), "head-nodes")
    tops = stored(tops.join(paths.where("depth = head").select("conv", "depth", "up1", "up2"), ["conv", "depth"]), "tops")
    up = lambda df: df.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2"))
    children = up(nodes).unionByName(up(tops)).groupBy("depth", "p1", "p2").agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "head-nodes")
    values = (nodes.select("conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
                           ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
              .unionByName(tops.select("conv", "depth", F.col("n_leaves").alias("leaves"), "saved")))
    valued = (paths.where("depth <= head").select("conv", "depth", "head", "p1", "p2").join(values, ["conv", "depth"], "left")
              .select("conv", "depth", "head", "p1", "p2", (-F.col("depth")).alias("back"), F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved")))
    summed = upto(valued, "conv", "back", {"n_leaves": (F.sum, _sum, "leaves"), "all_saved": (F.sum, _sum, "saved")})
    sums = summed.where("depth < head").groupBy("depth", "p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("all_saved").alias("saved"))
    nodes = nodes.join(sums, ["depth", "p1", "p2"]).drop("n_bytes")

    # parents of heads and containers' tops; digests of the members that end
    columns_ = ["conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "end", "up1", "up2"]
    outer = stored(nodes.select(*columns_).unionByName(tops.select(*columns_)), "outer")
    owners = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv").alias("parent_conv"))
    linked = lookup(outer.where("depth > 0"), stored(owners, "owners"), ["depth", "up1", "up2"]).unionByName(
        outer.where("depth = 0").withColumn("parent_conv", F.lit(None).cast("long")))
    every = stored(contained.where("not top").drop("top").unionByName(linked.drop("up1", "up2")), "nodes")
    digest = classes.select(F.col("conv").alias("end"), "ends")
    named = (every.where("end is null").withColumn("ends", F.lit(_NOTHING))
             .unionByName(every.where("end is not null").join(digest, "end").select(*every.columns, "ends")))
    return named.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
