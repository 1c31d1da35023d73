"""Helpers shared by the operators of this subpackage.

Intermediate tables that several branches read are written once as Parquet
under the shared folder named by `spark.checkpoint.dir` (`stored`), so that
a lost executor costs a re-read and never a wrong or missing row.
"""

from __future__ import annotations

import ctypes
import math
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: bytes of text that one block (the unit of the grouped passes) holds on average
BLOCK_BYTES = 8 << 20
#: edges that one task joins at the end of `components`
TASK_EDGES = 500_000
#: bytes of an Arrow batch between the JVM and its Python workers
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"llm-{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(df: DataFrame) -> SparkSession:
    """The frame's session, with this package importable in its workers, and
    with Arrow batches bounded in bytes unless the session sets a bound: a
    batch of 10 000 long texts would take many times a task's working memory."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return spark


def release() -> None:
    """Hand memory that the allocators of a reused worker hold back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, column: str = "text") -> int:
    """How many blocks of about BLOCK_BYTES the text makes, and at least one
    per shuffle partition; one number reaches the driver."""
    total = docs.agg(F.sum(F.octet_length(column))).head()[0] or 0
    return max(math.ceil(total / BLOCK_BYTES), shuffle_partitions(docs.sparkSession))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def in_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
              limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `limit` bytes of
    `column` (a single longer text makes a slice alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(
            pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64)
        cut = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
    release()


# --- words and hashes -------------------------------------------------------

def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8:
    exactly what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salt(i: int) -> np.uint64:
    return np.uint64(((i + 1) * _GOLD) & 0xFFFFFFFFFFFFFFFF)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles; fewer words
    make the whole sequence one shingle, no words the empty set."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    w = min(width, n)
    h = np.full(n - w + 1, salt(w), np.uint64)
    for i in range(w):
        h = mix(h ^ hashes[i:n - w + 1 + i]) + salt(i)
    return np.unique(h)


# --- connected components -----------------------------------------------------

class UnionFind:
    """Union by smallest label with path halving over sparse labels."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf = UnionFind()
    for batch in batches:
        for u, v in zip(*columns_of(batch, "u", "v")):
            uf.union(u, v)
    nodes = [(n, uf.find(n)) for n in list(uf.parent)]
    nodes = [(n, r) for n, r in nodes if n != r]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i:i + 50_000]
        yield pa.RecordBatch.from_pydict({"u": [n for n, _ in part], "v": [r for _, r in part]},
                                         schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component_id = smallest node reachable) of every node in an edge.

    Each task first reduces its own edges to a spanning forest with
    union-find.  If what remains fits one bounded task (`task_edges`), a last
    union-find ends it.  Otherwise alternating large-star and small-star
    rounds merge the forests across tasks: every round is two aggregates and
    two joins, and only the row count and a checksum of the edges come to
    the driver.  Both ways give the same components."""
    ready(edges)
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .mapInArrow(_forest, "u long, v long"))
    e, seen = stored(e, "forest"), None
    if e.count() <= task_edges:
        e = stored(e.repartition(1).mapInArrow(_forest, "u long, v long"), "stars")
        max_rounds = 0
    for _ in range(max_rounds):
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))))
        e = stored(small.distinct(), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        if max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()))


# --- joins and running totals that hold with hot keys ------------------------------

def lookup(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join of `rows` with `table`, which has one row per key `on`, when
    a key may hold any share of the rows.  Keys with more than one shuffle
    partition's share of the rows (fewer than there are partitions) meet their
    row of `table` by broadcast; the others by Spark's own choice of join."""
    parts = shuffle_partitions(rows.sparkSession)
    total = rows.agg(F.count("*").alias("n")).scalar()
    hot = rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") * parts > total).select(*on)
    hot = F.broadcast(stored(table.join(F.broadcast(stored(hot, "hot-keys")), on, "left_semi"), "hot-rows"))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(table, on, "left"))


def running(df: DataFrame, order: list, rank: str, sums: dict[str, str]) -> DataFrame:
    """`df` in the total order `order` with its rank (from 0) and, per entry
    name -> column of `sums`, the sum over all rows before.  Rows are dealt to
    ranges; one row per range gives what lies before it."""
    parts = stored(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
                   .withColumn("__part", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("__part").agg(F.count("*").alias("__n"), *[
        F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = before.select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c)
                                       for c in ["__n", *(f"__{name}" for name in sums)]])
    here = Window.partitionBy("__part").orderBy(*order)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(before), "__part").select(
        *df.columns, (F.col("__n") + F.row_number().over(here) - 1).alias(rank),
        *[(F.col(f"__{name}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(name) for name, c in sums.items()])
