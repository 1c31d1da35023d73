"""Exact line de-duplication across documents.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with
A-Z lower-cased.  Keys of at least `min_chars` code points that occur in at
least two documents lose all their lines except those in the smallest
doc_id that holds them.

How it runs:

1. One pass hashes every key (128 bits) and keeps, per (key, block of
   documents), the smallest and largest doc_id.  A block is a hash class of
   doc_id, so a line that a third of all documents share makes one row per
   block and not one per document.
2. Keys are dealt to shards by hash, again with smallest and largest doc_id
   per key only.  Each shard of repeated keys becomes a minimal perfect hash
   (levels of collision-free bits, index = rank of the bit) over compact
   arrays: fingerprint, count, smallest holder.
3. The blocks' keys probe the shards' arrays, and the hits come back to
   their block, where the documents drop their lines.

Nothing is collected on the driver but two counts.  Defined results: a null
or empty text is one empty line; a null doc_id keeps every line and holds
none; rows that share a doc_id count as one document; an empty table gives
an empty result; other columns pass through `dedup_lines` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, in_slices, ready, release, shuffle_partitions, stored

MIN_CHARS = 10
SHARD_KEYS = 500_000
_STRIP = " \t\n\x0b\x0c\r"
_LEVELS, _GAMMA = 64, 2.0


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key's UTF-8 bytes, or None if it is too short to count."""
    s = line.strip(_STRIP)
    return s.encode("utf-8", "surrogatepass").lower() if len(s) >= min_chars else None


def _key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


# --- minimal perfect hash over arrays ---------------------------------------

def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """A bit from both halves of a key: keys with one equal half part ways."""
    x = hi ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= lo
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def build_mph(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level; a key lives at the first level where it
    alone falls on its bit.  The pairs (hi, lo) of uint64 are distinct."""
    levels = []
    for level in range(_LEVELS):
        if not len(hi):
            return levels
        size = max(8, int(len(hi) * _GAMMA))
        at = _slot(hi, lo, level, size).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        levels.append(hits == 1)
        left = hits[at] != 1
        hi, lo = hi[left], lo[left]
    raise ValueError("the keys of a perfect hash must be distinct")


def probe_mph(levels: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Index of each key (0..n-1 for members, anything or -1 for others)."""
    out = np.full(len(hi), -1, np.int64)
    todo, base = np.arange(len(hi)), 0
    for level, bits in enumerate(levels):
        at = _slot(hi[todo], lo[todo], level, len(bits)).astype(np.int64)
        rank = np.cumsum(bits) - 1 + base
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + int(bits.sum())
    return out


def _pack(levels: list[np.ndarray]) -> bytes:
    sizes = np.array([len(levels), *map(len, levels)], "<i8").tobytes()
    return sizes + b"".join(np.packbits(b).tobytes() for b in levels)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(blob, "<i8", n, 8), 8 * (n + 1), []
    for size in sizes:
        size = int(size)
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
        at += (size + 7) // 8
    return out


# --- the passes ----------------------------------------------------------------

_LINES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("block", pa.int64()),
                    ("min_doc", pa.int64()), ("max_doc", pa.int64())])


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            seen: dict[tuple[int, bytes], list[int]] = {}
            docs, blocks, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, block, text in zip(docs, blocks, texts):
                if doc is None or not text:
                    continue
                for line in text.split("\n"):
                    key = line_key(line, min_chars)
                    if key is not None:
                        got = seen.setdefault((block, key), [doc, doc])
                        got[0], got[1] = min(got[0], doc), max(got[1], doc)
            if seen:
                h = [_key_hash(k) for _, k in seen]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array([x for x, _ in h], np.uint64).view(np.int64)),
                    pa.array(np.array([x for _, x in h], np.uint64).view(np.int64)),
                    pa.array([b for b, _ in seen], pa.int64()),
                    pa.array([v[0] for v in seen.values()], pa.int64()),
                    pa.array([v[1] for v in seen.values()], pa.int64())], schema=_LINES)
    return run


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _build_shard(table: pa.Table) -> pa.Table:
    hi, lo = _column(table, "hi").view(np.uint64), _column(table, "lo").view(np.uint64)
    levels = build_mph(hi, lo)
    at = probe_mph(levels, hi, lo)
    def placed(name, dtype):
        out = np.empty(len(at), dtype)
        out[at] = _column(table, name)
        return out.tobytes()
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                     "mph": pa.array([_pack(levels)], pa.binary()),
                     "fingerprints": pa.array([placed("lo", "<i8")], pa.binary()),
                     "counts": pa.array([placed("n_blocks", "<i8")], pa.binary()),
                     "holders": pa.array([placed("min_doc", "<i8")], pa.binary())})


def _probe_shard(index: pa.Table, probes: pa.Table) -> pa.Table:
    empty = pa.table({"block": pa.array([], pa.int64()), "hi": pa.array([], pa.int64()),
                      "lo": pa.array([], pa.int64()), "holder": pa.array([], pa.int64())})
    if not index.num_rows or not probes.num_rows:
        return empty
    row = {n: index.column(n)[0].as_py() for n in ("mph", "fingerprints", "holders")}
    fp, holder = np.frombuffer(row["fingerprints"], "<i8"), np.frombuffer(row["holders"], "<i8")
    hi, lo = _column(probes, "hi"), _column(probes, "lo")
    at = probe_mph(_unpack(row["mph"]), hi.view(np.uint64), lo.view(np.uint64))
    hit = (at >= 0) & (fp[at] == lo)
    hit &= _column(probes, "max_doc") != holder[at]   # a block with only the holder loses nothing
    return pa.table({"block": _column(probes, "block")[hit], "hi": hi[hit], "lo": lo[hit],
                     "holder": holder[at][hit]})


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard of repeated keys: (shard, mph, fingerprints, counts,
    holders).  The count is the number of document blocks that hold the key.
    Both halves of a key choose its place, so keys that agree in the first
    64 bits only are keys of their own."""
    repeated = (lines.groupBy("shard", "hi", "lo")
                .agg(F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc"),
                     F.count("*").alias("n_blocks")).where("min_doc != max_doc"))
    return repeated.groupBy("shard").applyInArrow(
        _build_shard, "shard long, mph binary, fingerprints binary, counts binary, holders binary")


def _drop_lines(min_chars: int):
    def run(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        release()
        holder = dict(zip(zip(verdicts.column("hi").to_pylist(), verdicts.column("lo").to_pylist()),
                          verdicts.column("holder").to_pylist()))
        signed = lambda h: tuple(x - (1 << 64) if x >> 63 else x for x in h)
        ids, texts = docs.column("__doc").to_pylist(), docs.column("__text").to_pylist()
        kept, n_lines, n_dropped = [], [], []
        for doc, text in zip(ids, texts):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if doc is not None and holder:
                stay = []
                for line in lines:
                    key = line_key(line, min_chars)
                    if key is None or holder.get(signed(_key_hash(key)), doc) == doc:
                        stay.append(line)
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            else:
                n_dropped.append(0)
                kept.append(text or "")
        out = docs.drop_columns(["__doc", "__text", "__block"])
        for name, col in (("kept_text", pa.array(kept, pa.string())),
                          ("n_lines", pa.array(n_lines, pa.int64())),
                          ("n_dropped", pa.array(n_dropped, pa.int64()))):
            out = out.append_column(f"__{name}", col)
        return out
    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns named by `keep` (all by default), and
    `__kept_text`, `__n_lines` (before dropping), `__n_dropped`."""
    spark = ready(docs)
    keep = docs.columns if keep is None else keep
    blocks = block_count(docs, text_col)
    block = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text_col), F.lit(blocks))).otherwise(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)))
    lines = (docs.select(F.col(id_col).cast("long").alias("doc"), block.alias("block"),
                         F.col(text_col).alias("text"))
             .mapInArrow(_line_rows(min_chars), "hi long, lo long, block long, min_doc long, max_doc long")
             .groupBy("hi", "lo", "block").agg(F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc")))
    lines = stored(lines, "lines")
    shards = max(shuffle_partitions(spark), math.ceil(lines.count() / SHARD_KEYS))
    lines = lines.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)))
    index = stored(build_index(lines, shards), "line-index")
    verdicts = (index.groupBy("shard").cogroup(lines.groupBy("shard"))
                .applyInArrow(_probe_shard, "block long, hi long, lo long, holder long"))
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text"),
                       block.alias("__block"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + ["`__kept_text` string", "`__n_lines` bigint", "`__n_dropped` bigint"])
    return (rows.groupBy("__block").cogroup(verdicts.groupBy("block"))
            .applyInArrow(_drop_lines(min_chars), schema))
