"""Mixing sources to target weights, in DataFrame functions only.

Targets.  Sources, by code point with null last, take the weights in turn;
the mix is as large as the corpus.  A source's target stops at `cap` times its
size, and what it leaves goes to the others by weight until none is above.
That is one level for all: with sources in order of size / weight, the capped
ones come first, and running sums tell where the level lies.

Documents.  A source at target / size = 2.4 takes every document twice, as
certain whole copies, and 40 % of its words once more.  These come by Pareto
order sampling: a document with random number u and inclusion probability p
has rank (u / (1 - u)) / (p / (1 - p)), and the smallest ranks are taken while
their words fit what the target still asks for, so that the sample has a fixed
size in words.  p differs from source to source and is the same within one.
u comes from a digest of the document's id, so reruns agree.  One last
document, the nearest in size to the words still missing, closes the gap
(if that brings the sum nearer).

No source is sorted in one task: its documents are dealt to cells of about
CELL_ROWS by u (ranks grow with u), the cells' word counts give what lies
before each cell, and only within a cell are documents ordered.

Defined results: null or empty text has size 0 and is taken with 0 words; a
null doc_id draws u from its text; rows that share a doc_id are documents of
their own that draw the same u, the smaller first; a source without words has
target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, ready, running, stored

WEIGHTS, CAP = (5, 2, 1), 3
CELL_ROWS = 4096
_SPACE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, docs, source_size), one row per source: the same and its
    weight and target."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = running(sizes, [F.col("source").asc_nulls_last()], "__rank", {})
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights)).cast("int"))
                               .cast("long")).drop("__rank")
    unit = math.lcm(*weights)
    ranked = ranked.withColumn("__level", F.col("source_size") * F.floor(unit / F.col("weight")))
    level = running(ranked, [F.col("__level"), F.col("source").asc_nulls_last()], "__rank",
                    {"__words": "source_size", "__weights": "weight"})
    level = stored(level.withColumn("__total", sizes.agg(F.sum("source_size")).scalar())
                   .withColumn("__all", ranked.agg(F.sum("weight")).scalar())
                   .withColumn("__capped", cap * whole("source_size") * (whole("__all") - whole("__weights"))
                               < whole("weight") * (whole("__total") - cap * whole("__words"))), "levels")
    left = level.agg(F.sum(F.when(~F.col("__capped"), F.col("weight"))).alias("w"),
                     (F.max("__total") - F.coalesce(F.sum(F.when(F.col("__capped"), cap * F.col("source_size"))),
                                                    F.lit(0))).alias("r"))
    share = (F.col("weight") * left.select("r").scalar()).cast("double") / left.select("w").scalar()
    return level.select("source", "docs", "source_size", "weight", F.when(
        F.col("__capped"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target,
    copies (how often the mix holds it) and taken (words, repeats counted)."""
    ready(docs)
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.coalesce(F.col(text_col), F.lit(""))))
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(seed))), 1, 13), 16, 10).cast("long")
    sized = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("skey"),
        n_words(F.col(text_col)).alias("size"), ((digits + 0.5) / 2.0 ** 52).alias("u")), "sized")
    per_source = stored(source_targets(
        sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), weights, cap), "targets")
    per_source = per_source.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "docs", "source_size", "target")

    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    p = F.col("rest") / F.col("source_size")
    placed = (lookup(sized, per_source, ["skey"]).withColumn("certain", F.floor(e))
              .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
              .withColumn("rank", F.when(F.col("rest") > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
              .withColumn("cell", F.floor(F.col("u") * F.ceil(F.col("docs") / CELL_ROWS))).drop("u", "docs"))
    placed = stored(placed, "placed")
    ahead = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("skey", "cell").agg(F.sum("size").alias("words"))
    cells = cells.select("skey", "cell", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("skey", "cell").orderBy("rank", "doc_id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ordered = stored(placed.join(cells, ["skey", "cell"]).withColumn("upto", F.col("before") + upto)
                     .withColumn("at", F.row_number().over(inside))
                     .withColumn("picked", (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))).drop("before"), "ordered")

    gap = ordered.where("rest > 0").groupBy("skey").agg(
        (F.max("rest") - F.coalesce(F.max(F.when(F.col("picked"), F.col("upto"))), F.lit(0))).alias("gap"))
    nearest = (ordered.where("rest > 0 and not picked and size > 0").groupBy("skey", "size")
               .agg(F.min(F.struct("rank", "doc_id", "cell", "at")).alias("first")).join(gap, "skey")
               .withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap").groupBy("skey")
               .agg(F.min(F.struct("off", "size", "first"))["first"].alias("f"))
               .select("skey", "f.cell", "f.at", F.lit(1).alias("closing")))
    copies = F.col("certain") + F.col("picked").cast("long") + F.coalesce("closing", F.lit(0))
    return (ordered.join(nearest, ["skey", "cell", "at"], "left")
            .select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
                    (F.col("size") * copies).cast("long").alias("taken")))
