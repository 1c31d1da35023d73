"""Quality rules, WARC records and chat windows against direct versions."""

import gzip
import hashlib
import math
import random
from collections import Counter

import pytest
from brute import ODD_TEXTS, by_id, rows, sha

from tidewater.llm import chat, quality, warc
from tidewater.llm.common import scratch

# --- quality ----------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w)}


def test_counts(docs_of):
    rng = random.Random(2)
    texts = ODD_TEXTS + [" ".join(rng.choice("a b c # * é".split()) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["p q r s t " * k for k in range(4)] + ["a a a a a a", "x\ny\nx\n \n \nx", " wide space\x85 " * 3]
    got = by_id(quality.with_counts(docs_of(list(enumerate(texts))), keep=["doc_id"]))
    assert {d: {k: v for k, v in r.items() if k != "doc_id"} for d, r in got.items()} == {
        i: brute_counts(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    from pyspark.sql import functions as F
    cases = [(k, n) for n in (1, 5, 40, 300, 2000) for k in (0, 1, 2, 3, 7, 9) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p"))
    for k, n, p in df.collect():
        true = sum(math.comb(n, i) * 0.005 ** i * 0.995 ** (n - i) for i in range(k + 1))
        assert p == (1.0 if k >= n * 0.005 else pytest.approx(true, rel=1e-9))


def test_thresholds_hold_the_risk(spark, docs_of):
    """A stratum with enough good documents gets a cutoff, one with few gets none, and junk goes."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(3000):
        junk = i % 10 == 3
        docs.append((i, " ".join(word() + "#" * (junk and rng.random() < 0.9) for _ in range(20))))
        labels.append((i, int(not junk), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    frame = docs_of(docs).withColumn("lang", F.when(F.col("doc_id") < 200, "few").otherwise("many"))
    got = by_id(quality.judge(frame, lab))
    good = [d for d, q, _ in labels if q]
    assert sum(not got[d]["kept"] for d in good if not got[d]["base_failed"]) <= quality.ALPHA * len(good)
    assert all(got[d]["kept"] or got[d]["base_failed"] for d in range(200))
    assert all("symbols" in got[d]["rejected_by"] for d, q, _ in labels if not q and d >= 200)


def test_quality_runs_without_python_and_on_odd_input(spark, docs_of):
    lab = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0)], "doc_id long, quality int")
    docs = docs_of([(None, "a b"), (None, None), (1, "x " * 50_000), (1, "x")])
    out = quality.judge(docs, lab)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in rows(out)) == [
        (0, 0, False), (0, 2, False), (1, 1, False), (1, 50_000, False)]
    assert quality.judge(docs.where("false"), lab).count() == 0
    assert quality.judge(docs, lab.where("false")).count() == 4


# --- WARC -------------------------------------------------------------------------


def pages_of(spark, data):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in data],
                                 "page_id long, url string, html string, payload string, size int").repartition(2)


def test_pages_survive_the_archive(spark):
    big = "0123456789é日\r\n\r\nWARC/1.1 " * 200
    data = [(1, "http://a/ \r\nX: y", big), (2, None, big), (9, "http://b", big), (3, "u", "small"), (4, "u", "small"),
            (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (11, "é", "\x00" * 70_000)]
    path = scratch(spark, "warc-test")
    warc.write_archives(pages_of(spark, data), path, segment_bytes=700, records_per_file=3)
    got = rows(warc.read_archives(spark, path))
    assert len(got) == len(data)
    for i, _, html in data:
        r = next(r for r in got if r["page_id"] == i)
        if i in (1, 2):
            assert (r["record_type"], r["refers_to"], r["payload"], r["complete"]) == ("revisit", 9, None, True)
        else:
            assert (r["record_type"], r["refers_to"], r["complete"]) == ("response", None, True)
            assert bytes(r["payload"]) == (html or "").encode()
            assert (r["n_segments"] > 1) == (len((html or "").encode()) > 600)


def test_repeated_rows_and_no_rows(spark):
    path = scratch(spark, "warc-test")
    same = "y" * 5000
    warc.write_archives(pages_of(spark, [(3, "u", same), (3, "u", same), (2, "u", same)]), path, segment_bytes=900)
    got = rows(warc.read_archives(spark, path))
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, len(r["payload"] or b"")) for r in got) == [
        (2, "revisit", 3, 0), (3, "response", 0, 5000), (3, "response", 0, 5000)]
    path = scratch(spark, "warc-test")
    warc.write_archives(pages_of(spark, [(1, "u", "x")]).where("false"), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("damage", ["none", "order", "missing", "total", "twice"])
def test_segments_of_other_writers(spark, tmp_path, damage):
    payload = bytes(range(256)) * 20
    records = warc.page_records(5, 0, "http://x", hashlib.sha1(payload).hexdigest(), payload, None, "d", 1000)
    assert len(records) == 6
    if damage == "order":
        records = records[::-1]
    elif damage == "missing":
        del records[2]
    elif damage == "total":
        records[-1] = records[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    elif damage == "twice":
        records += records[1:3]
    for i in range(2):                                              # two files, each record a gzip member of its own
        (tmp_path / f"{i}.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[i::2]))
    (r,) = rows(warc.read_archives(spark, str(tmp_path)))
    whole = damage not in ("missing", "total")
    assert (r["page_id"], r["complete"], r["payload"] and bytes(r["payload"])) == (5, whole, payload if whole else None)


def test_other_records_and_damaged_archives(spark, tmp_path):
    records = [warc.page_records(i, 0, "http://x", "d", b"page %d" % i, None, "d", 1000)[0] for i in range(4)]
    others = [b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 5\r\n\r\nhello" % t for t in (b"warcinfo", b"request", b"metadata")]
    ended = [r + b"\r\n\r\n" for r in (others[0], records[0], others[1], records[1], others[2])]
    (tmp_path / "plain.warc").write_bytes(b"".join(ended))
    cut = gzip.compress(records[2] + b"\r\n\r\n") + gzip.compress(records[3] + b"\r\n\r\n")[:-60]
    (tmp_path / "cut.warc.gz").write_bytes(cut)
    bad = records[3].replace(b"Content-Length: ", b"Content-Length: x")
    short = records[3][:-4]
    (tmp_path / "bad.warc").write_bytes(b"no record\r\n" + bad + b"\r\n\r\n" + records[2] + b"\r\n\r\n" + short)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "junk.warc.gz").write_bytes(b"\x1f\x8bjunk")
    got = sorted((r["page_id"], r["complete"], bytes(r["payload"] or b"")) for r in rows(warc.read_archives(spark, str(tmp_path))))
    assert got[:2] == [(0, True, b"page 0"), (1, True, b"page 1")]
    assert [g for g in got if g[0] == 2] == [(2, True, b"page 2")] * 2
    assert all(not complete and not payload for page, complete, payload in got if page == 3) and len(got) in (5, 6)


def test_chunked_framing():
    for n in (0, 1, 7, 8, 9, 100):
        assert warc.dechunked(warc.chunked(b"z" * n, 8)) == b"z" * n
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"3\r\nabcX\r\n0\r\n\r\n", b"zz\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.dechunked(bad) is None


# --- chat --------------------------------------------------------------------------

QUOTES = ["\\### Assistant: </turn> ok", "\\", "\\\\", "####", "#" * 7, "\\h\\e", "</turn>", " </turn>\n", "### User: x", "",
          "\\\\h###</turn>\\", "~", ": ", "a\n\n### ~System: b </turn>\n"]


def conversations(rng, n=25):
    out = []
    for c in range(n):
        if rng.random() < 0.5:
            out.append((c, 0, "system", rng.choice(QUOTES) * 3))
        for t in range(1, rng.randint(2, 30)):
            text = " ".join(rng.choice(QUOTES + ["word", "日本"]) for _ in range(rng.choice([1, 3, 40, 200])))
            out.append((c, t, rng.choice(["user", "assistant", "tool: ~x###"]), text))
    return out + [(100, 0, None, None), (101, 1, "assistant", "tie"), (101, 1, "assistant", "tie"), (101, 1, "user", "tie"),
                  (None, 0, "user", "no id"), (102, None, "assistant", "no turn"), (102, 4, "system", "late"),
                  (103, 0, "system", "long " * 2000), (103, 1, "assistant", "short"), (104, 0, "assistant", "x" * 30_000)]


def test_windows_read_back(spark):
    data = conversations(random.Random(4))
    turns = spark.createDataFrame([(*r, "x", 1) for r in data],
                                  "conv_id long, turn long, role string, text string, window string, kind int").repartition(3)
    windows = chat.format_windows(turns, budget=600, history_tokens=100)
    got = by_id(chat.digests(chat.read_back(windows)), "conv_id")
    groups = {}
    for c, t, role, text in data:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, rows_ in groups.items():
        rows_.sort()
        loss = "".join(x for _, r, x in rows_ if r == "assistant")
        assert got[c]["n_turns"] == len(rows_)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in rows_))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    made = rows(windows)
    assert any(w["window"] > 3 for w in made) and any(chat.OPEN + chat.REPEATED in w["formatted"] for w in made)
    def costs(w):
        return [-(-(len(t.replace(chat.OPEN + chat.REPEATED, chat.OPEN)) + len(chat.CLOSE)) // chat.CHARS_PER_TOKEN)
                for t in w["formatted"].split(chat.CLOSE)[:-1]]
    for w in made:                          # over budget only by a turn that fits no window with the system turn
        assert w["tokens"] == sum(costs(w)) and w["over_budget"] == (w["tokens"] > 600)
        if w["over_budget"]:
            assert w["n_own"] == 1 and len(costs(w)) == 1 + (w["formatted"].startswith(chat.OPEN + chat.REPEATED + "system"))


def test_long_turns_have_windows_of_their_own(spark):
    """A turn longer than the stride, but not than the budget, stays within it."""
    texts = ["s" * 400, "a" * 100, "b" * 4500, "c" * 100, "d" * 7000, "e" * 50, "f" * 3300, "g" * 3300, "h" * 9000]
    turns = spark.createDataFrame([(1, i, "system" if i == 0 else "assistant", x) for i, x in enumerate(texts)],
                                  "conv_id long, turn long, role string, text string")
    made = sorted(rows(chat.format_windows(turns)), key=lambda w: w["window"])
    assert [w["over_budget"] for w in made] == [False] * (len(made) - 1) + [True]
    assert all(w["formatted"].startswith(chat.OPEN + chat.REPEATED + "system") for w in made[1:])
    got = rows(chat.digests(chat.read_back(chat.format_windows(turns))))[0]
    assert got["loss_sha256"] == sha("".join(texts[1:])) and got["n_turns"] == len(texts)


def test_one_shuffle_and_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.read_back(chat.format_windows(turns)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert not any(w in plan for w in ("PythonUDF", "Pandas", "InArrow"))
    assert chat.format_windows(turns.where("false")).count() == 0
