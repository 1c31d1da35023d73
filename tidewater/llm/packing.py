"""Packing of tokenised documents into fixed-length sequences.

1. Every whole text becomes token ids plus one end id; ids are cut into
   pieces of at most `length` tokens.
2. The histogram of piece lengths (at most `length` rows) is planned on the
   driver, shortest pack first: lengths are placed longest first, each into
   the packs with the most room left, and only (pattern, count) pairs are
   kept, so the plan's size does not depend on the corpus.  The gaps that
   remain are closed by emptying the packs with the most room and cutting
   their pieces to fit the others (`fill_gaps`); only rooms of less than
   1/64 of a pack stay open.
3. Pieces get a rank within their length, in two steps (counts per hash
   bucket, then a running sum over buckets) so that a length that a third
   of all documents share is not ranked in one task.  Patterns then join the
   pieces by (length, rank), which gives sequence and offset, and for a cut
   piece one row per part.

Ids come from the byte-level BPE vocabulary whose path is a parameter.
Defined results: a null or empty text has only the end id; a null doc_id is
packed like any other; repeated rows are packed once per row; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, in_slices, ready, shuffle_partitions, stored

LENGTH = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def vocabulary() -> tuple[str, str]:
    """(path of the ranks file, split pattern) of the default vocabulary.

    The ranks are those of byte_bpe_50k.json, whose ids the tests compare;
    the path is looked up in each worker, so only the name travels."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(text: str | None, vocab: tuple[str, str] | None = None, end_id: int = END_ID) -> np.ndarray:
    """The whole text's ids and the end id, little-endian unsigned 32 bit."""
    ids = _encoder(*(vocab or vocabulary())).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, end_id).astype("<u4")


def _pieces(length: int, vocab: tuple[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, limit=4 << 20):
            out = {"doc_id": [], "start": [], "length": [], "doc_tokens": [], "ids": []}
            for doc, text in zip(*columns_of(batch, "id", "text")):
                ids = encode(text, vocab)
                for start in range(0, len(ids), length):
                    piece = ids[start:start + length]
                    for name, v in zip(out, (doc, start, len(piece), len(ids), piece.tobytes())):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                 ("doc_tokens", pa.int64()), ("ids", pa.binary())]))
    return run


def tokenise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
             vocab: tuple[str, str] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids): ids little-endian unsigned 32 bit."""
    ready(docs)
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_pieces(length, vocab), "doc_id long, start long, length long, doc_tokens long, ids binary"))


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), from {length: count}.

    Lengths go longest first; each joins the packs that are shortest so far,
    that is, those with the most room, as long as it fits there."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for item in sorted(histogram, reverse=True):
        left = histogram[item]
        while left:
            room = max(packs, default=0)
            if room < item:                                        # new packs, filled with this length
                each = length // item
                for n, count in ((each, left // each), (left % each, 1)):
                    if n and count:
                        packs.setdefault(length - n * item, []).append(((item,) * n, count))
                break
            pattern, count = packs[room].pop()
            used = min(count, left)
            left -= used
            if count > used:
                packs[room].append((pattern, count - used))
            if not packs[room]:
                del packs[room]
            packs.setdefault(room - item, []).append(((*pattern, item), used))
    return [p for room in sorted(packs) for p in packs[room]]


class Part(NamedTuple):
    """Tokens [skip, skip + size) of the pieces of `length` from rank `rank`
    on, one rank for each pack of a pattern."""

    length: int
    rank: int
    skip: int
    size: int


Pattern = tuple[int | Part, ...]


def _size(item: int | Part) -> int:
    return item.size if isinstance(item, Part) else item


def _after(items: Pattern, n: int) -> Pattern:
    """The items of a pattern's packs that follow its first `n`."""
    return tuple(i._replace(rank=i.rank + n) if isinstance(i, Part) else i for i in items)


def fill_gaps(patterns: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """The packs with their rooms closed, and per length how many pieces, from
    rank 0 on, are given by `Part`s.

    The packs with the most room are emptied, as many as the rooms of the
    others can take in.  Their pieces go longest first into the largest room,
    whole if they fit; else as much as fits is cut off and the rest goes on.
    Rooms of less than length / 64 are left."""
    least = max(1, length // 64)
    done, loose, rooms, opened = [], [], [], {}
    by_room = sorted(((length - sum(p), p, n) for p, n in patterns), reverse=True)
    free, content = sum(room * n for room, _, n in by_room if room >= least), 0
    for room, pattern, count in by_room:
        n = min(count, max(0, free - content) // length) if room >= least else 0
        free, content = free - n * room, content + n * (length - room)
        for item in pattern if n else ():
            rank = opened.get(item, 0)
            heapq.heappush(loose, (-item, Part(item, rank, 0, item), n))
            opened[item] = rank + n
        if count > n:
            if room >= least:
                heapq.heappush(rooms, (-room, len(rooms), pattern, count - n))
            else:
                done.append((pattern, count))
    serial = len(rooms)                                            # patterns are not compared
    while loose:
        size, part, count = heapq.heappop(loose)
        if not rooms:
            tokens = part.size * count + sum(p.size * n for _, p, n in loose)
            rooms.append((-length, serial, (), max(1, tokens // length)))
        room, _, pattern, packs = heapq.heappop(rooms)
        n, take = min(count, packs), min(part.size, -room)
        if count > n:
            heapq.heappush(loose, (size, part._replace(rank=part.rank + n), count - n))
        if part.size > take:
            heapq.heappush(loose, (take - part.size, part._replace(skip=part.skip + take, size=part.size - take), n))
        if packs > n:
            heapq.heappush(rooms, (room, serial + 1, _after(pattern, n), packs - n))
        pattern = (*pattern, part._replace(size=take))
        if -room - take >= least:
            heapq.heappush(rooms, (room + take, serial + 2, pattern, n))
        else:
            done.append((pattern, n))
        serial += 3
    return done + [(pattern, n) for _, _, pattern, n in sorted(rooms)], opened


def layout(patterns: list[tuple[Pattern, int]], opened: dict[int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of a
    length with these ranks go, in order and whole, to successive sequences.
    Ranks begin after the `opened` ones."""
    rows, used, base = [], dict(opened or {}), 0
    for pattern, count in patterns:
        offset = 0
        for item in pattern:
            if not isinstance(item, Part):
                rank = used.get(item, 0)
                rows.append((item, rank, rank + count, base, offset))
                used[item] = rank + count
            offset += _size(item)
        base += count
    return rows


def layout_parts(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, skip, size) of
    the parts."""
    rows, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for item in pattern:
            if isinstance(item, Part):
                rows.append((item.length, item.rank, item.rank + count, base, offset, item.skip, item.size))
            offset += _size(item)
        base += count
    return rows


def pack(pieces: DataFrame, *, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces and parts of pieces with their sequence_id and offset.

    `pieces` has doc_id, start, length (at most `length`), ids and ids_crc32
    and is read twice; pass a written table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    patterns, opened = fill_gaps(shortest_pack_first(histogram, length), length)
    parts = layout_parts(patterns)
    rows = [(*row, 0, row[0]) for row in layout(patterns, opened)] + parts
    # ranks are looked up by stretches, of which a length has as many as plan rows: a piece meets few rows
    per = Counter(row[0] for row in rows)
    stretch = {n: -(-histogram[n] // c) for n, c in per.items()}
    plan = (spark.createDataFrame([(*row, stretch[row[0]]) for row in rows],
                                  "p_length long, p_from long, p_to long, p_sequence long, p_offset long, "
                                  "p_skip long, p_size long, width long")
            .withColumn("p_stretch", F.explode(F.expr("sequence(p_from div width, (p_to - 1) div width)"))).drop("width"))
    widths = spark.createDataFrame(list(stretch.items()), "length long, width long")
    kept = [c for c in pieces.columns if with_ids or c != "ids"]
    if not with_ids:                                               # ids travel only where a cut needs them
        cut = sorted({row[0] for row in parts if row[6] < row[0]})
        pieces = pieces.withColumn("ids", F.when(F.col("length").isin(cut), F.col("ids"))) if cut else pieces.drop("ids")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", F.lit(3)),
                                              F.lit(shuffle_partitions(spark))))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
            .select("length", "salt", F.coalesce(before, F.lit(0)).alias("base")))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", *[
        c for c in pieces.columns if c not in ("doc_id", "start", "length")])
    ranked = (salted.withColumn("local", F.row_number().over(order)).join(base, ["length", "salt"])
              .withColumn("rank", F.col("base") + F.col("local") - 1))
    ranked = ranked.join(F.broadcast(widths), "length").withColumn("stretch", F.expr("rank div width"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("stretch") == F.col("p_stretch"))
                         & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))   # the plan is bounded by the pack length
    if "ids" in pieces.columns:
        whole = F.col("p_size") == F.col("length")
        own = F.substring("ids", (F.col("p_skip") * 4 + 1).cast("int"), (F.col("p_size") * 4).cast("int"))
        placed = (placed.withColumn("ids", F.when(whole, F.col("ids")).otherwise(own))
                  .withColumn("ids_crc32", F.when(whole, F.col("ids_crc32")).otherwise(F.crc32("ids"))))
    return (placed.withColumns({"start": F.col("start") + F.col("p_skip"), "length": F.col("p_size")})
            .select(*kept, (F.col("p_sequence") + F.col("rank") - F.col("p_from")).alias("sequence_id"),
                    F.col("p_offset").alias("offset")))


def packed(docs: DataFrame, *, length: int = LENGTH, vocab: tuple[str, str] | None = None,
           with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves if asked for."""
    pieces = tokenise(docs, length=length, vocab=vocab).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    return pack(stored(pieces.select(*columns), "pieces"), length=length, with_ids=with_ids)
