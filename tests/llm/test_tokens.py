"""Tokenising, packing, toxicity and vectors against libraries and direct versions."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from brute import ODD_TEXTS, by_id, group, rows
from pyspark.sql import functions as F

from tidewater.llm import embedding_dedup, packing, sentencepiece_codec, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts_for_tokens():
    rng = random.Random(8)
    pool = "abcdefgh ABC é ß 日本 1234567890 .,;!?'\"()[]{}#*\n\t\r  　\x1c\x85 ❤️👩‍👩‍👧 ▁ don't we'll <|endoftext|> <s>"
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    out += [" " * k + r for k in range(0, 50, 3) for r in ("", "a", "hello world", "日", "\n")]
    return [t for t in ODD_TEXTS if t is not None] + out


# --- SentencePiece ---------------------------------------------------------------

def library(path):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def ids_of(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_bpe_ids_equal_the_library():
    texts = texts_for_tokens()
    model = sentencepiece_codec.Model(sentencepiece_codec.default_model())
    want = library(sentencepiece_codec.default_model()).encode(texts)
    assert [ids_of(b) for b in model.encode(texts)] == want
    assert [model.decode(w) for w in want] == [t.replace("▁", " ") for t in texts]


def unigram_model(tmp_path):
    """The same vocabulary read as a unigram model, with scores a lattice can tell apart."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(sentencepiece_codec.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    rng = random.Random(4)
    for p in m.pieces:
        if p.type == 1:
            p.score = -3.0 - 9.0 * rng.random()
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_ids_equal_the_library(tmp_path):
    path = unigram_model(tmp_path)
    model, texts = sentencepiece_codec.Model(path), texts_for_tokens()
    assert model.kind == sentencepiece_codec.UNIGRAM
    assert [ids_of(b) for b in model.encode(texts)] == library(path).encode(texts)


def test_words_of_any_length_agree():
    model = sentencepiece_codec.Model(sentencepiece_codec.default_model())
    rng = random.Random(1)
    for size in (1, 2, 7, 30, 40):
        words = ["▁" + "".join(rng.choice("etaoinsr\né日") for _ in range(size)) for _ in range(40)]
        assert model.encode_equal(words) == [model.encode_long(w) for w in words]


def test_hash_collisions_are_caught(monkeypatch):
    """Wrong pieces behind equal hashes must not reach the result."""
    model = sentencepiece_codec.Model(sentencepiece_codec.default_model())
    want = model.encode_equal(["▁other", "▁words"])
    model.values = np.roll(model.values, 1)
    assert model.encode_equal(["▁other", "▁words"]) == want


def test_codec_frames(docs_of):
    docs = docs_of(list(enumerate(ODD_TEXTS)))
    ids = sentencepiece_codec.encode(docs, ids_col="tokens")
    got = by_id(sentencepiece_codec.decode(ids, ids_col="tokens"))
    want = library(sentencepiece_codec.default_model()).encode([t or "" for t in ODD_TEXTS])
    assert {d: r["tokens"] for d, r in got.items()} == dict(enumerate(want))
    assert {d: r["decoded"] for d, r in got.items()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD_TEXTS)}
    both = by_id(sentencepiece_codec.encode(docs, ids_col="tokens", decoded_col="decoded", keep=["doc_id"]))
    assert both == {d: {k: r[k] for k in ("doc_id", "tokens", "decoded")} for d, r in got.items()}
    assert sentencepiece_codec.encode(docs.where("false"), ids_col="tokens", decoded_col="d").count() == 0


# --- packing -----------------------------------------------------------------------

def tokenizer_ids(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizers_library():
    for t in texts_for_tokens():
        assert packing.encode(t).tolist() == tokenizer_ids(t)


def test_packing_places_every_id_once(docs_of):
    rng = random.Random(3)
    texts = ODD_TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    texts += ["same text"] * 60
    got = rows(packing.packed(docs_of(list(enumerate(texts))), length=256, with_ids=True))
    want = {i: np.array(tokenizer_ids(t), "<u4") for i, t in enumerate(texts)}
    for r in got:
        piece = want[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()
        assert bytes(r["ids"]) == piece and r["ids_crc32"] == zlib.crc32(piece)
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and 0 < r["length"] <= 256
    for key, at in (("doc_id", "start"), ("sequence_id", "offset")):
        groups = {}
        for r in got:
            groups.setdefault(r[key], []).append((r[at], r["length"]))
        for pieces in groups.values():
            pieces.sort()
            assert [a for a, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
            assert key == "doc_id" or sum(n for _, n in pieces) <= 256
    total = sum(r["length"] for r in got)
    sequences = len({r["sequence_id"] for r in got})
    assert sequences <= total / 256 * 1.03 + 1


def test_packing_null_ids_repeated_rows_and_no_rows(docs_of):
    got = rows(packing.packed(docs_of([(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (6, None)])))
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 3), (0, 3), (5, 3), (5, 3), (6, 1)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5
    assert packing.packed(docs_of([(1, "x")]).where("false")).count() == 0


def test_shortest_pack_first_by_hand():
    assert packing.shortest_pack_first({6: 2, 4: 1, 3: 3}, 10) == [((6, 4), 1), ((6, 3), 1), ((3, 3), 1)]
    assert packing.layout([((6, 4), 2), ((6,), 1)]) == [(6, 0, 2, 0, 0), (4, 0, 2, 0, 6), (6, 2, 3, 2, 0)]


def skewed_lengths():
    """A third of the pieces at one length just above half a pack, the rest spread evenly."""
    return {**{n: 5 for n in range(1, 2049)}, 1100: 5000}


def test_gaps_are_filled_by_counted_cuts():
    histogram = skewed_lengths()
    patterns, opened = packing.fill_gaps(packing.shortest_pack_first(histogram))
    tokens = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in patterns) <= tokens / 2048 * 1.02 + 1
    assert all(0 < sum(map(packing._size, p)) <= 2048 for p, _ in patterns)
    rows_ = [(*r, 0, r[0]) for r in packing.layout(patterns, opened)] + packing.layout_parts(patterns)
    assert len(rows_) < 20 * 2048
    covered, places = {}, {}
    for n, a, b, sequence, offset, skip, size in rows_:
        for i in range(b - a):
            covered.setdefault((n, a + i), []).append((skip, size))
            places.setdefault(sequence + i, []).append((offset, size))
    assert {n: sum(k[0] == n for k in covered) for n in (1, 700, 1100, 2048)} == {n: histogram[n] for n in (1, 700, 1100, 2048)}
    assert len(covered) == sum(histogram.values())
    for groups, whole in ((covered, True), (places, False)):
        for key, got in groups.items():
            got.sort()
            assert [a for a, _ in got] == np.cumsum([0] + [n for _, n in got])[:-1].tolist()
            assert not whole or sum(n for _, n in got) == key[0]


@pytest.mark.parametrize("with_ids", [True, False])
def test_packing_cuts_pieces_where_whole_ones_leave_gaps(docs_of, with_ids):
    """A third of the documents just above half a pack: their ids stay whole, with little padding."""
    rng = random.Random(2)
    texts = [" a" * 139] * 60 + [" b" * rng.randint(150, 250) for _ in range(120)] + [None, ""]
    got = rows(packing.packed(docs_of(list(enumerate(texts))), length=256, with_ids=with_ids))
    want = {i: np.array(tokenizer_ids(t), "<u4") for i, t in enumerate(texts)}
    docs = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes())
        assert ("ids" in r) == with_ids and (not with_ids or zlib.crc32(bytes(r["ids"])) == r["ids_crc32"])
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in docs.items()} == {d: len(v) for d, v in want.items()}
    for p in docs.values():
        p.sort()
        assert [a for a, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist()
    assert len({r["sequence_id"] for r in got}) <= sum(map(len, want.values())) / 256 * 1.03 + 1


# --- toxicity ------------------------------------------------------------------------

def toy(spark, n=600):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 1
        w = [word() for _ in range(rng.randint(3, 60))]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["nasty", "VILE", "rotten"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(spark, docs_of):
    docs, labels, rows_ = toy(spark)
    frame = docs_of(docs)
    model = toxicity.train(frame, labels)
    got = by_id(toxicity.score(frame, model, keep=["doc_id"]).withColumn("held", toxicity.held_out("doc_id")))
    held = [(d, t) for d, _, t in rows_ if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r["held"]} == {d for d, _ in held}
    assert np.mean([(got[d]["__score"] >= 0.5) == bool(t) for d, t in held]) > 0.97
    assert all(0 <= r["__score"] <= 1 for r in got.values())


def test_held_out_labels_are_not_learned_from(spark, docs_of):
    docs, labels, rows_ = toy(spark, 200)
    frame = docs_of(docs)
    flipped = spark.createDataFrame(
        [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in rows_], labels.schema)
    one, two = toxicity.train(frame, labels), toxicity.train(frame, flipped)
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]) and one[2] == two[2]


def test_scores_of_odd_rows(spark, docs_of):
    docs, labels, _ = toy(spark, 120)
    frame = docs_of(docs + [(None, "nasty"), (3, "nasty"), (1000, None), (1001, ""), (1002, "word " * 50_000)])
    bad = spark.createDataFrame([(None, 1, 1), (5, 1, None), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(frame, toxicity.train(frame, labels.union(bad)))
    assert scored.count() == 125 and scored.where("__score is null or isnan(__score)").count() == 0
    nothing = toxicity.train(frame, labels.where("false"))
    assert toxicity.score(frame, nothing).where("__score >= 0.5").count() == 0
    assert toxicity.score(frame.where("false"), nothing).count() == 0


def scalar_features(text):
    """Hashed words, pairs and skip-grams, one at a time in whole numbers."""
    full = (1 << 64) - 1

    def spread(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    def salted(x, i):
        return (x + (i + 1) * 0x9E3779B97F4A7C15) & full
    h = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    out = {spread(x) for x in h}
    for gap, s in ((1, 5), (2, 9)):
        out |= {spread(salted(a, s) ^ spread(b)) for a, b in zip(h, h[gap:])}
    return {x % toxicity.DIM for x in out}


def scalar_ftrl(rows_by_epoch):
    """Weights by coordinate and the bias (None), from one update after the other."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        least = 0.0 if i is None else toxicity.L1
        if abs(z[i]) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) * toxicity.ALPHA / (toxicity.BETA + math.sqrt(n[i]))
    for e, rows_ in enumerate(rows_by_epoch):
        for y, features in rows_:
            at = [None, *sorted(features)]
            w = [weight(i) for i in at]
            g = (1 / (1 + math.exp(-sum(w))) - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
            for i, wi in zip(at, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * wi
                n[i] += g * g
        if e < len(rows_by_epoch) - 1:                              # the state is kept in single precision
            for d in (z, n):
                d.update({i: float(np.float32(v)) for i, v in d.items() if i is not None})
    return {i: weight(i) for i in list(z)}


def test_learner_and_scores_against_scalar_updates(spark):
    rng = random.Random(4)
    marked = [(i, 1, int(rng.random() < 0.3)) for i in range(900)]
    docs = [(i, " ".join(rng.choices([f"w{k}" for k in range(14)], [1 + y * (k % 5) for k in range(14)], k=rng.randint(0, 9))))
            for i, _, y in marked]
    labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    at, w, bias = model = toxicity.train(frame, labels)
    text = dict(docs)
    used = {i: y for i, _, y in marked if zlib.crc32(str(i).encode()) % 5 and i in text}
    ids = spark.createDataFrame([(i,) for i in used], "id long").select(
        "id", *[F.xxhash64("id", F.lit(100 + e)).alias(f"t{e}") for e in range(toxicity.EPOCHS)]).collect()
    want = scalar_ftrl([[(used[r["id"]], scalar_features(text[r["id"]])) for r in sorted(ids, key=lambda r: (r[f"t{e}"], r["id"]))]
                        for e in range(toxicity.EPOCHS)])
    got = dict(zip(at.tolist(), w.tolist()))
    assert len(got) > 5 and abs(want.pop(None) - bias) < 1e-6
    assert set(got) == {i for i, v in want.items() if v}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-5
    for r in toxicity.score(frame, model, keep=["doc_id"]).collect():
        total = bias + sum(got.get(i, 0.0) for i in scalar_features(text[r["doc_id"]]))
        assert abs(r["__score"] - 1 / (1 + math.exp(-total))) < 1e-9


# --- vectors ---------------------------------------------------------------------------

def vector_rows(seed=7):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in ((90, 0.01), (40, 0.03), (12, 0.035), (3, 0.02)):
        c = rng.normal(size=16)
        out += [(c / np.linalg.norm(c) + noise * rng.normal(size=16)).tolist() for _ in range(size)]
    out += rng.normal(size=(150, 16)).tolist()
    out += [out[0], out[0], (np.array(out[0]) * 7).tolist(), None, [0.0] * 16, [], [1.0, None] + [0.0] * 14,
            [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.001], [1e300] * 16, [-1e-300] * 16, [1e-300] * 16]
    order = rng.permutation(len(out))
    return [(int(i), out[j]) for i, j in enumerate(order)]


def brute_vectors(data):
    x = {}
    for i, v in data:
        if v and None not in v and np.isfinite(np.array(v)).all() and np.abs(v).max() > 0:
            u = np.array(v) / np.abs(v).max()
            x[i] = u / np.linalg.norm(u)
    links = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.95]
    label = group([i for i, _ in data], links)
    n = dict.fromkeys(label, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], label[i], label[i] == i) for i in label}


@pytest.mark.parametrize("shard", [25, 1000])
def test_vectors(spark, shard):
    data = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in data],
                               "vec_id long, embedding array<double>, label int, id string, cell string").repartition(3)
    got = by_id(embedding_dedup.near_duplicates(df, shard=shard, audit=50), "vec_id")
    want = brute_vectors(data)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == want
    assert {r["audit_recall"] for r in got.values()} == {1.0}


def test_vectors_null_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [1.0, 0.01])],
                               "vec_id long, embedding array<float>")
    got = rows(embedding_dedup.near_duplicates(df))
    assert sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"]) == [
        (4, 1, 4, True), (4, 1, 4, True), (7, 1, 4, False)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_unlike_vectors_of_one_id(spark):
    """Each vector has its own links; an id's vectors are in one component."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    data = [(9, near(a)), (4, a), (4, b), (4, b), (8, near(b)), (2, near(c)), (7, c), (7, near(a)), (1, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    got = rows(embedding_dedup.near_duplicates(df))
    pairs = {(i, tuple(v)) for i, v in data}
    unit = {p: np.array(p[1]) / np.linalg.norm(p[1]) for p in pairs}
    links = {p: [q for q in pairs if q != p and unit[p] @ unit[q] >= 0.95] for p in pairs}
    label = group([i for i, _ in data], [(p[0], q[0]) for p in pairs for q in links[p]])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted(
        (i, len(links[(i, tuple(v))]), label[i], label[i] == i) for i, v in data)
    assert {r["audit_recall"] for r in got} == {1.0} and label[2] == label[4] == 2


def test_low_recall_forces_the_wider_way(spark, monkeypatch):
    """A search that loses links is repeated over all blocks; one that still does stops the call."""
    tried, real = [], embedding_dedup._search

    def losing(reps, width, k, overlap, *more):
        tried.append((k, overlap))
        out = real(reps, width, k, overlap, *more)
        return out if k == 1 and overlap == 1 and allow else out.where("false")
    monkeypatch.setattr(embedding_dedup, "_search", losing)
    data = vector_rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    allow = True
    got = by_id(embedding_dedup.near_duplicates(df, shard=50), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == brute_vectors(data)
    assert [o for _, o in tried] == [3, 6, 1] and tried[-1] == (1, 1)
    allow = False
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.near_duplicates(df, shard=50)


def test_pruned_lists_keep_a_way_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(100, 8)), np.ones((60, 8)) + 0.001 * rng.normal(size=(60, 8))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = embedding_dedup.build_graph(x, 1)
    assert (lists != np.arange(160)[:, None]).all() and (lists[:, 0] >= 0).all()
    assert ((lists[100:] < 100) & (lists[100:] >= 0)).any()        # the dense cluster links to the outside
