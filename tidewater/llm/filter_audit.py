"""How five document filters interact, in every order.

Filters (a document fails when): A fewer than 100 words; B under 80 %
distinct words; C over 10 % of the characters in A-Z; D any of `#$%&*|`;
E its text is identical to that of a smaller doc_id.

E is decided with radix tries.  A bounded sample of distinct texts gives
adaptive prefixes as borders: where many texts begin alike the prefixes grow
until the border tells them apart.  The borders cut the order of all texts
into ranges of about RANGE_BYTES, and serve balance only; every text of every
document goes to the range it belongs to.
1. A task inserts its documents' whole texts into a compressed trie (edges
   are byte strings), whose terminals hold the smallest id and the documents
   that end there.  Walking the trie, documents above the smallest id are
   known copies; one text goes on per trie, so a text that a third of all
   documents share travels once per task and not once per document.
2. A range's task does the same with the texts that arrive and settles the
   rest.
Results are one 5-bit mask of failed filters per document.

Masks are reduced to counts per part and mask (32 at most, with the labels
that matter).  All 120 orders and Shapley sums follow from these counts.

Defined results: null text is empty, null lang the part ''; a row without a
doc_id neither fails E nor makes others fail it; rows that share a doc_id
are documents of their own, and equal ones don't fail E by each other; of
several labels of a doc_id any 1 counts; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, ready, shuffle_partitions, stored

FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
#: bytes of text in a range, on average
RANGE_BYTES = 16 << 20
#: texts drawn for the borders, about, and how many characters of each are looked at first
SAMPLE, PREFIX = 50_000, 32
#: a task hands on its trie when its texts reach this size, or its documents this number
TRIE_BYTES, TRIE_ROWS = 16 << 20, 200_000


# --- the trie -----------------------------------------------------------------

def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """`edges`: first byte -> (label, node).  A terminal has `least`, the smallest
    id of the texts that end here, and `held`, {(id, part): [mask, copies]}."""
    __slots__ = ("edges", "least", "held")

    def __init__(self):
        self.edges, self.least, self.held = {}, None, None


class RadixTrie:
    """A compressed trie over whole texts."""

    def __init__(self):
        self.root, self.bytes, self.rows = Node(), 0, 0

    def end_of(self, text: bytes) -> Node:
        """The node where `text` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                new = Node()
                node.edges[text[at]] = (text[at:], new)
                self.bytes += len(text) - at
                return new
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            cut = common_prefix(label, text[at:at + len(label)])
            fork = Node()
            fork.edges[label[cut]] = (label[cut:], below)
            node.edges[text[at]] = (label[:cut], fork)
            node, at = fork, at + cut
        return node

    def insert(self, text: bytes, doc: int, part: str, mask: int, copies: int) -> None:
        node = self.end_of(text)
        if node.held is None:
            node.least, node.held = doc, {}
        node.least = min(node.least, doc)
        known = node.held.setdefault((doc, part), [mask, 0])
        self.rows += not known[1]
        known[1] += copies

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """(text, node) of every terminal."""
        stack = [(b"", b"", self.root)]
        while stack:
            above, label, node = stack.pop()
            text = above + label
            if node.held is not None:
                yield text, node
            stack.extend((text, label, below) for label, below in node.edges.values())


# --- masks ----------------------------------------------------------------------

def own_mask(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITAL_PERCENT * n_chars) << 2
            | (len(text.translate(None, _MARKS)) < len(text)) << 3)


_ROWS = "doc_id long, part string, mask int, copies long, place int, text binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("copies", pa.int64()),
                     ("place", pa.int32()), ("text", pa.binary())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about 4 MB of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + len(row[5] or b"")
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def _settled(trie: RadixTrie, borders: list[bytes] | None) -> Iterator[tuple]:
    """Walk the trie: copies of a smaller id are settled, and in a range's
    trie (no `borders`) the smallest ids too; else they go on with their text."""
    for text, node in trie.terminals():
        where = 0 if borders is None else bisect_right(borders, text)
        for (doc, part), (mask, copies) in node.held.items():
            if doc > node.least:
                yield doc, part, mask | _E, copies, doc % 1_000_003, None
            else:
                yield doc, part, mask, copies, where, None if borders is None else text


def _first_pass(borders: list[bytes], trie_bytes: int, trie_rows: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = RadixTrie()
        for batch in in_slices(batches, limit=2 << 20):
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "part", "text")}
            chars = pc.utf8_length(col["text"]).to_pylist()
            for doc, part, text, n in zip(col["doc_id"].to_pylist(), col["part"].to_pylist(),
                                          col["text"].cast(pa.binary()).to_pylist(), chars):
                mask = own_mask(text, n)
                if doc is None:
                    yield None, part, mask, 1, len(text), None
                else:
                    trie.insert(text, doc, part, mask, 1)
            if trie.bytes > trie_bytes or trie.rows > trie_rows:
                yield from _settled(trie, borders)
                trie = RadixTrie()
        yield from _settled(trie, borders)

    return lambda batches: _batches(rows(batches))


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie = RadixTrie()
        for batch in batches:
            for doc, part, mask, copies, _, text in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if text is None:
                    yield doc, part, mask, copies, 0, None
                else:
                    trie.insert(text, doc, part, mask, copies)
        yield from _settled(trie, None)

    return _batches(rows())


# --- ranges ------------------------------------------------------------------------

def borders_of(texts: DataFrame, ranges: int, *, sample: int = SAMPLE, prefix: int = PREFIX) -> list[bytes]:
    """Sorted prefixes that cut the order of the distinct texts into about
    `ranges` ranges of equal size.  Texts drawn by their hash (copies
    together, so a text counts once) are looked at `prefix` characters deep.
    Those that still agree though they make more than a range are looked at
    deeper, four times the characters of a quarter of them, until no such
    texts are left; so what comes to the driver stays within about
    `sample` * `prefix` characters at every depth."""
    n = texts.agg(F.count("*")).head()[0]
    if ranges < 2 or not n:
        return []
    classes, depth, keep = math.ceil(n / sample), prefix, 1
    drawn = texts.select("text", F.xxhash64("text").alias("h"), (F.octet_length("text") + 1).alias("size"))
    borders, heavy, weight = set(), None, None
    while True:
        rows = drawn.where(F.pmod("h", F.lit(classes * keep)) == 0)
        if heavy:
            rows = rows.where(F.substring("text", 1, depth // 4).isin(sorted(heavy)))
        got = sorted((r.p, r.size * keep) for r in rows.select("h", "size", F.substring("text", 1, depth).alias("p"))
                     .dropDuplicates(["h"]).collect())
        weight = weight or sum(s for _, s in got) / ranges
        upto, same = 0, {}
        for p, s in got:
            if upto // weight != (upto + s) // weight:
                borders.add(p.encode())
            upto += s
            same.setdefault(p, []).append(s)
        heavy = [p for p, sizes in same.items() if len(p) == depth and len(sizes) > 1 and sum(sizes) > weight]
        if not heavy:
            return sorted(borders)
        depth, keep = depth * 4, keep * 4


def masks(docs: DataFrame, *, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text",
          range_bytes: int = RANGE_BYTES, trie_bytes: int = TRIE_BYTES, trie_rows: int = TRIE_ROWS,
          sample: int = SAMPLE, prefix: int = PREFIX) -> DataFrame:
    """doc_id, part, mask (bit i: the document fails FILTERS[i]) and copies,
    the number of documents with that id, part and text."""
    spark = ready(docs)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    ranges = max(math.ceil(total / range_bytes), shuffle_partitions(spark))
    borders = borders_of(src, ranges, sample=sample, prefix=prefix)
    n = len(borders) + 1
    first = src.mapInArrow(_first_pass(borders, trie_bytes, trie_rows), _ROWS)
    dealt = first.repartitionById(n, F.pmod("place", F.lit(n)).cast("int"))
    return dealt.mapInArrow(_last_pass, _ROWS).select("doc_id", "part", "mask", "copies")


# --- orders ------------------------------------------------------------------------

def _steps() -> str:
    """JSON rows of every order and step: the filter's bit and the mask of those before."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "own": 1 << f,
                        "before": sum(1 << i for i in order[:step])})
    return json.dumps(out)


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """From (doc_id, part, mask, copies), one row per part, order and step."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = (labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(one("quality"), F.lit(0)).alias("good"), F.coalesce(one("toxic"), F.lit(0)).alias("toxic")))
    failed = stored(failed, "masks")
    known = failed.where("doc_id is not null").join(marks, "doc_id", "left")
    nameless = failed.where("doc_id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    counts = (known.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("copies").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("copies")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("copies")).otherwise(0)).alias("toxic")))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = counts.select("*", F.inline(steps))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    out = rows.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~earlier, "n").alias("kept"), total(fails & ~earlier, "n").alias("removed"),
        total(fails & earlier, "n").alias("redundant"), total(F.col("mask") == F.col("own"), "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.  `options` as in `masks`."""
    return interactions(masks(docs, **options), labels)
