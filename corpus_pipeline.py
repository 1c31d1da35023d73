"""A training-corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read back as the next stage's input.  All stages but
the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, minhash, packing, suffix_dedup, toxicity
from tidewater.llm.common import stored
from tidewater.sources.bridges import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """`rows` with its column `text` in place of the documents' text."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(new).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, doesn't reject."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("__score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds."""
    return _with_text(line_dedup.dedup_lines(docs), docs, "__kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (5 words, similarity 0.8)."""
    gone = minhash.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte passages that a smaller id holds too.
    Characters cut in two go as a whole; a document cut to nothing stays, empty."""
    return _with_text(suffix_dedup.cut_repeats(docs, as_text=True), docs, "__kept")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in sequences of 2048."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
