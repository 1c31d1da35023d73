"""Registered queries against DuckDB, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from brute import cut_passages, kept_lines, near_copies, rows

import __spark_entry__ as E
import corpus_pipeline
from tidewater.llm import packing, toxicity
from tidewater.llm.common import stored
from tidewater.llm.oracles import SQL
from tidewater.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_registered():
    assert set(SQL) <= set(QUERIES) <= set(E.queries())
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) - set(SQL) == {"op1_sentencepiece", "op6_packing", "op7_toxicity"}   # tested against libraries
    assert E.queries()["pipeline"].__name__ == "run"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.sql(SQL[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert got == sorted(repr(tuple(r[at[c]] for c in cols)) for r in rel.fetchall())


def test_pipeline_stage_by_stage(spark):
    """Each stage against a direct version over the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ended = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in rows(docs)}
        texts = [(d, r["text"]) for d, r in before.items()]
        out = stored(stage(spark, docs, SF), "test")
        got = rows(out)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            gone = {r["doc_id"] for r in rows(toxicity.score(docs, model).where("__score >= 0.5"))}
            assert {r["doc_id"] for r in got} == set(before) - gone
            assert all(r == before[r["doc_id"]] for r in got)
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in got} == {d: v[2] for d, v in kept_lines(texts).items()}
        elif name == "minhash_dedup":
            assert {r["doc_id"] for r in got} == {d for d, v in near_copies(texts, 5).items() if v[2]}
        elif name == "suffix_dedup":
            want = cut_passages(texts)
            assert {r["doc_id"]: r["text"] for r in got} == {d: v[3].decode("utf-8", "ignore") for d, v in want.items()}
        else:
            assert sum(r["length"] for r in got) == sum(len(packing.encode(t)) for _, t in texts)
            ended = got
        if name != "packing":
            assert out.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] != before[r["doc_id"]]["text"])
        docs = out
    assert ended == sorted(ended, key=ended.index) and len(ended) == len({(r["doc_id"], r["start"]) for r in ended})


def test_stages_take_odd_documents(spark, docs_of):
    docs = docs_of([(None, None), (None, "a line that is null"), (1, ""), (2, "x " * 30_000), (2, "x " * 30_000), (3, "short")])
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, frame, SF), "odd")
            if name == "packing":
                assert out.count() >= frame.count()
            else:
                assert out.columns == frame.columns
                assert out.where("doc_id is null").count() == frame.where("doc_id is null").count()
            frame = out if name != "packing" else frame
