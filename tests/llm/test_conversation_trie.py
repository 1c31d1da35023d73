"""The conversation trie against one built node by node."""

import hashlib
import zlib

import pytest
from brute import rows

from tidewater.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth string, head string, conv string"


def make(spark, turns):
    return spark.createDataFrame([(*t, "x", "x", "x") for t in turns], SCHEMA).repartition(3)


def direct(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0], t[1].encode(), t[2].encode()))] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(lender, [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        value = (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += value
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in rows(df)), key=repr)


def some_turns():
    turns = []
    for c in range(-12, 60):
        for t in range(c % 7 + 1 + 9 * (c % 4 == 0)):
            shared = t < 3 or c % 3 == 0
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", f"{'same é' if shared else c} {t}"))
    return turns


@pytest.mark.parametrize("container_rows", [1, 12, 4096])
def test_every_node(spark, container_rows):
    turns = some_turns()
    assert got(ct.trie(make(spark, turns), container_rows=container_rows)) == direct(turns)


def test_copies_long_common_beginnings_and_long_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK_BITS", 3)                      # running values over many chunks
    turns = [(c, 100 * t - 900, "user", f"common {t}") for c in range(0, 60, 5) for t in range(40)]
    turns += [(c, 5000 + t, "assistant", f"{c} {t}") for c in (20, 25, 30) for t in range(30)]
    turns += [(c, t, None, "copy") for c in range(101, 160) for t in range(2)]
    assert got(ct.trie(make(spark, turns), container_rows=60)) == direct(turns)


def test_odd_rows(spark):
    turns = [(1, None, None, None), (1, None, "user", ""), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (1, 0, "A", "tie"), (2, 3, "x:", "y"),
             (2, 3, "x", ":y"), (None, 1, "user", "lost"), (None, None, None, None), (5, 1, "user", "z" * 9000), (7, 1, "user", "z" * 9000),
             (-4, 0, "user", "minus"), (0, 0, "user", "zero"), (-5, -1, "user", "below"), (10 ** 15, 2, "é", "日本")]
    assert got(ct.trie(make(spark, turns))) == direct(turns)
    assert got(ct.trie(make(spark, turns), container_rows=1)) == direct(turns)
    assert got(ct.trie(make(spark, turns).where("false"))) == []
    assert got(ct.trie(make(spark, [(None, 0, "user", "x")]))) == []
