"""Line, near-copy and passage de-duplication against direct versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import ODD_TEXTS, by_id, cut_passages, kept_lines, near_copies, rows, sha

from tidewater.llm import line_dedup, minhash, suffix_dedup
from tidewater.llm.common import components


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(25)]
    docs = list(enumerate(ODD_TEXTS))
    shared = [" ".join(word() for _ in range(25)) for _ in range(4)]
    for w in base:
        for edits in (0, 0, 1, 3, 9):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = word()
            lines = [" ".join(v[i:i + 12]) for i in range(0, len(v), 12)]
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
            if rng.random() < 0.3:
                lines[0] = lines[0].upper() + " "
            docs.append((len(docs), "\n".join(lines)))
    rng.shuffle(docs)
    return docs


def test_lines(docs_of, corpus):
    got = by_id(line_dedup.dedup_lines(docs_of(corpus)))
    want = kept_lines(corpus)
    assert {d: (r["__n_lines"], r["__n_dropped"], r["__kept_text"]) for d, r in got.items()} == want
    assert any(v[1] for v in want.values())
    assert all(r["n_lines"] == "x" for r in got.values())         # other columns pass through


def test_lines_null_id_keeps_all_and_equal_ids_are_one_document(docs_of):
    line = "a line that is long enough"
    got = rows(line_dedup.dedup_lines(docs_of([(None, line), (None, line), (3, line), (3, line), (5, line)])))
    assert sorted((r["doc_id"] or 0, r["__n_dropped"]) for r in got) == [(0, 0), (0, 0), (3, 0), (3, 0), (5, 1)]


def test_perfect_hash_places_every_key_once_and_rejects_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    levels = line_dedup._unpack(line_dedup._pack(line_dedup.build_mph(keys, keys)))
    assert sorted(line_dedup.probe_mph(levels, keys, keys)) == list(range(len(keys)))
    assert len(line_dedup.build_mph(keys[:0], keys[:0])) == 0
    with pytest.raises(ValueError):
        line_dedup.build_mph(np.array([7, 7], np.uint64), np.array([1, 1], np.uint64))


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies(docs_of, corpus, width):
    got = by_id(minhash.near_duplicates(docs_of(corpus), width=width))
    want = near_copies(corpus, width)
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == want
    assert any(not v[2] for v in want.values())


def test_near_copies_null_and_repeated_ids(docs_of):
    t = "one two three four five six"
    got = rows(minhash.near_duplicates(docs_of([(None, t), (4, t), (4, t), (9, t), (2, "")]), width=2))
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [
        (2, 2, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_families_are_compared_in_blocks(docs_of, monkeypatch):
    """A chain in which most members are unlike the smallest: only the block comparison finds its links."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(60)]
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 7)
    got = by_id(minhash.near_duplicates(docs_of(docs), width=2))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == near_copies(docs)


def test_superminhash_slots_and_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [x[:1], x[:40], x[:2000], x[200:2200]]
    owner = np.repeat(np.arange(4), [len(s) for s in sets])
    sig = minhash.superminhash(np.concatenate(sets), owner, 4, 112)
    assert (sig != minhash._NONE).all()
    assert sorted(sig[0] >> np.uint64(56)) == list(range(112))     # one element fills every slot, one rank each
    assert abs((sig[2] == sig[3]).mean() - 1800 / 2200) < 0.15


def test_passages(docs_of, corpus):
    got = by_id(suffix_dedup.cut_repeats(docs_of(corpus)))
    want = cut_passages(corpus)
    assert {d: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for d, r in got.items()} == want
    assert any(0 < v[1] < v[0] for v in want.values())


@pytest.mark.parametrize("texts", [
    ["a" * 49, "a" * 49], ["a" * 50, "a" * 49, "a" * 50], ["ab" * 400, "a" + "ab" * 30 + "c", "ba" * 25],
    ["é" * 40, "x" + "é" * 40, "é" * 25], ["\x00" * 200, "\x00" * 120 + "end"]])
def test_passages_of_repetitive_texts(docs_of, texts):
    docs = list(enumerate(texts, 10))
    got = by_id(suffix_dedup.cut_repeats(docs_of(docs)))
    assert {d: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for d, r in got.items()} \
        == cut_passages(docs)


def test_passages_null_and_repeated_ids(docs_of):
    t = "0123456789" * 8
    got = rows(suffix_dedup.cut_repeats(docs_of([(None, t), (4, t), (4, t), (9, "z" + t)]), as_text=True))
    assert sorted((r["doc_id"] or 0, r["__kept"]) for r in got) == [(0, t), (4, t), (4, t), (9, "z")]


@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_chunks_slices_and_splits_do_not_change_the_result(corpus, monkeypatch, hot):
    """The same anchors and sorts in far smaller pieces, in this process, and
    with all, some or no anchors split into windows."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    monkeypatch.setattr(suffix_dedup, "_SORTED", 8)
    notes = pa.table({"block": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "half": pa.array([], pa.int64())})
    tables = [pa.table({"__doc": [d for d, _ in part], "__text": [t for _, t in part], "__block": [b] * len(part)})
              for b, part in ((b, [p for p in corpus if p[0] % 3 == b and len(p[1] or "") < 4000]) for b in range(3))]
    sent = pa.concat_tables([suffix_dedup._send_anchors(5)(t, notes) for t in tables])
    def by_shard(table, f):
        return pa.concat_tables([f(table.filter(pa.compute.equal(table.column("shard"), i)))
                                 for i in sorted(set(table.column("shard").to_pylist()))])
    shared = by_shard(sent, suffix_dedup._shared)
    shared = shared.append_column("doc", pa.array([None] * len(shared), pa.int64())).append_column("half", pa.array([None] * len(shared), pa.int64()))
    def own(table, b):
        return table.filter(pa.compute.equal(table.column("block"), b))
    ctx = pa.concat_tables([suffix_dedup._send_contexts(5)(t, own(shared, b)) for b, t in enumerate(tables)])
    verdict = by_shard(ctx, suffix_dedup._judge)
    verdict = verdict.append_column("doc", pa.array([None] * len(verdict), pa.int64())).append_column("half", pa.array([None] * len(verdict), pa.int64()))
    got = {}
    for b, t in enumerate(tables):
        out = suffix_dedup._cut(False)(t.append_column("doc_id", t.column("__doc")), own(verdict, b))
        got.update({r["doc_id"]: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], r["__kept"]) for r in out.to_pylist()})
    assert got == cut_passages([p for p in corpus if len(p[1] or "") < 4000])


def test_cut_characters_go_as_a_whole_and_make_no_new_ones(docs_of):
    """The removed run begins inside one character and ends inside another; the rest of the two would make a third."""
    run = "é".encode()[1:] + b"0123456789" * 5 + "ä".encode()[:1]      # in the middle of é...ä
    first, later = "\u00e9" + "0123456789" * 5 + "\u00c4", "x\u0169" + "0123456789" * 5 + "\u00e8y"
    assert run[:1] == later.encode()[2:3] and run[-1:] == later.encode()[-3:-2]
    got = by_id(suffix_dedup.cut_repeats(docs_of([(1, first), (2, later)]), as_text=True))
    gone = [a <= i < b for a, b in [(2, 54)] for i in range(len(later.encode()))]
    want, at = "", 0
    for c in later:
        n = len(c.encode())
        want += c * (not any(gone[at:at + n]))
        at += n
    assert want == "xy" and got[2]["__n_removed"] == 52
    assert (got[1]["__kept"], got[2]["__kept"]) == (first, want)


def test_passages_do_not_depend_on_the_order_of_rows(corpus, monkeypatch):
    """Each pass receives a block's rows in an order of its own."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    docs = [p for p in corpus if len(p[1] or "") < 4000]
    rng = random.Random(9)

    def dealt():
        out = []
        for b in range(3):
            part = [p for p in docs if p[0] % 3 == b]
            rng.shuffle(part)
            out.append(pa.table({"__doc": [d for d, _ in part], "__text": [t for _, t in part], "__block": [b] * len(part)}))
        return out

    def by(table, key, f):
        return pa.concat_tables([f(table.filter(pa.compute.equal(table.column(key), i)))
                                 for i in sorted(set(table.column(key).to_pylist()))])

    def own(table, b):
        table = table.filter(pa.compute.equal(table.column("block"), b))
        return table.append_column("doc", pa.array([None] * len(table), pa.int64())).append_column("half", pa.array([None] * len(table), pa.int64()))
    none = pa.table({"block": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "half": pa.array([], pa.int64())})
    sent = pa.concat_tables([suffix_dedup._send_anchors(5)(t, none) for t in dealt()])
    shared = by(sent, "shard", suffix_dedup._shared)
    ctx = pa.concat_tables([suffix_dedup._send_contexts(5)(t, own(shared, b)) for b, t in enumerate(dealt())])
    verdict = by(ctx, "shard", suffix_dedup._judge)
    got = {}
    for b, t in enumerate(dealt()):
        out = suffix_dedup._cut(False)(t.append_column("doc_id", t.column("__doc")), own(verdict, b))
        got.update({r["doc_id"]: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], r["__kept"]) for r in out.to_pylist()})
    assert got == cut_passages(docs)


def test_equal_hashes_of_other_bytes_are_told_apart(monkeypatch):
    """With all prefix hashes equal, the byte check must undo every match."""
    monkeypatch.setattr(suffix_dedup, "prefix_hashes", lambda c: np.zeros((c.shape[1] + 1, len(c)), np.uint64))
    ctx = np.arange(2 * suffix_dedup._WIDE, dtype=np.uint8).reshape(2, -1)
    row, start, least = suffix_dedup.smallest_ids(np.zeros(2, np.uint64), ctx, np.array([1, 1]), np.array([5, 5]),
                                                  np.array([3, 8]))
    assert list(least) == [3, 8]


def test_empty_tables(docs_of):
    docs = docs_of([(1, "x")]).where("false")
    assert line_dedup.dedup_lines(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert suffix_dedup.cut_repeats(docs).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 300), (300, 900)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    want = {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 560), 500), 300: 300, 900: 300}
    for limit in (10, 1000):                                       # star rounds, and one bounded task
        got = components(df, "a", "b", task_edges=limit).collect()
        assert len(got) == len(want) and {r["node"]: r["component_id"] for r in got} == want
        assert components(df.where("false"), "a", "b", task_edges=limit).count() == 0


def test_digest_of_kept_text(spark, docs_of):
    from tidewater.llm.common import stored
    df = stored(line_dedup.dedup_lines(docs_of([(1, "é\nline")])), "t")
    assert df.selectExpr("sha2(cast(__kept_text as binary), 256) AS h").head()["h"] == sha("é\nline")


def test_keys_with_one_equal_half(spark, docs_of, monkeypatch):
    """Line keys whose first 64 bits all agree are told apart by the others."""
    same = np.full(3000, 7, np.uint64)
    other = np.arange(3000).astype(np.uint64)
    for hi, lo in ((same, other), (other, same)):
        assert sorted(line_dedup.probe_mph(line_dedup.build_mph(hi, lo), hi, lo)) == list(range(3000))
    table = pa.table({"shard": [0] * 3000, "hi": same.view(np.int64), "lo": other.view(np.int64), "n_blocks": [1] * 3000,
                      "min_doc": np.arange(3000), "max_doc": np.arange(3000) + 1})
    index = line_dedup._build_shard(table)
    probes = pa.table({"block": [5] * 3001, "hi": np.full(3001, 7), "lo": np.arange(3001), "max_doc": np.arange(3001) + 1})
    got = line_dedup._probe_shard(index, probes)
    assert sorted(zip(got.column("lo").to_pylist(), got.column("holder").to_pylist())) == [(i, i) for i in range(3000)]


def test_unlike_rows_of_one_id(spark, docs_of):
    """Rows that share an id: one node for links, documents of their own for bytes."""
    a = " ".join(f"alpha{i}" for i in range(16))
    b = " ".join(f"beta{i}" for i in range(16))
    got = rows(minhash.near_duplicates(docs_of([(4, a), (4, b), (9, b + " tail"), (11, "other words here")]), width=2))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(4, 4, True), (9, 4, False), (11, 11, True)}
    got = rows(minhash.near_duplicates(docs_of([(2, a), (4, a), (4, b), (9, b + " tail")]), width=2))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(2, 2), (4, 2), (9, 2)} and len(got) == 4
    got = rows(suffix_dedup.cut_repeats(docs_of([(2, a), (4, a), (4, b), (5, "x" + b)]), keep=["doc_id"]))
    assert sorted((r["doc_id"], r["__n_bytes"], r["__n_removed"]) for r in got) == sorted(
        [(2, len(a), 0), (4, len(a), len(a)), (4, len(b), 0), (5, len(b) + 1, len(b))])
