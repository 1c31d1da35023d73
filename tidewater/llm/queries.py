"""The operators of this subpackage applied to the driver's tables.

Every query reads its whole table and derives the digest columns from its
operator's real outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bridges import read_table
from . import (chat, conversation_trie, embedding_dedup, filter_audit, line_dedup, minhash, mixing, packing, quality, sentencepiece_codec,
               suffix_dedup, toxicity, warc)
from .common import scratch, stored


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and a digest of the text they decode to."""
    ids = sentencepiece_codec.encode(read_table(spark, sf_dir, "documents"), keep=["doc_id"], decoded_col="decoded")
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: 2-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the risk-controlled rules."""
    out = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, and what reading them back gives."""
    path = scratch(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    read = stored(warc.read_archives(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", "refers_to", "n_segments", "complete"), "records")
    full = (read.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest")).dropDuplicates(["refers_to"]))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "complete"]
    again = read.where("refers_to is not null").drop("payload_bytes", "payload_digest").join(full, "refers_to", "left")
    return read.where("refers_to is null").select(*columns).union(again.withColumnsRenamed(
        {"full_bytes": "payload_bytes", "full_digest": "payload_digest"}).select(*columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated across documents, dropped but in the smallest doc_id."""
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                      F.sha2(F.col("__kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into sequences of at most 2048."""
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with cosine similarity 0.95 or more, whatever their labels."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte passages that a smaller doc_id holds too, cut out."""
    out = suffix_dedup.cut_repeats(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"),
                      F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes the template, formatted into
    budgeted windows and read back."""
    turns = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    quoting = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digests(chat.read_back(chat.format_windows(turns.unionByName(quoting))))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, node by node."""
    return conversation_trie.trie(read_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in every order and part."""
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix whose sources weigh 5, 2, 1 in turn."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_minhash_dedup, op3_quality_rules, op4_warc_segments, op5_line_dedup, op6_packing, op7_toxicity, op8_embedding_dedup, op9_suffix_dedup, op10_chat_format, op11_conversation_trie, op12_filter_audit, op13_source_mix)}
