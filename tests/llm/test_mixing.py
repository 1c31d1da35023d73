"""Source mixing against a direct computation of targets and sums."""

from fractions import Fraction

import pytest
from brute import ODD_TEXTS, rows

from tidewater.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, cell string, rank string"


def make(spark, triples):
    return spark.createDataFrame([(d, t, s, "x", "x", "x", "x") for d, t, s in triples], SCHEMA).repartition(3)


def words(text):
    return len((text or "").encode("utf-8", "surrogatepass").split())


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Share, cap, reshare what is above, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in open_)) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return {s: float(share[s]) if s in share else float(cap * sizes[s]) for s in names}
        capped |= above


def check(triples, got):
    sizes = {}
    for _, t, s in triples:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken, longest = targets(sizes), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    assert len(got) == len(triples)
    by_key = {(r["doc_id"], r["source"], r["size"]) for r in got}
    assert by_key == {(d, s, words(t)) for d, t, s in triples}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12, abs=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        e = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(e - 1e-9) <= r["copies"] <= int(e + 1e-9) + 1
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    return taken, want


def test_targets_and_sums_with_a_hot_and_a_capped_source(spark):
    triples = [(i, "w " * (1 + i * i % 97), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    triples += [(5000 + i, "w " * 5, "A small one") for i in range(4)] + [(6000 + i, "a b", None) for i in range(50)]
    df = make(spark, triples)
    got = rows(mixing.mix(df))
    taken, want = check(triples, got)
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=5)
    again = rows(mixing.mix(df.repartition(7)))
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_inclusion_follows_the_stated_share(spark):
    """Over seeds, every document comes about as often as its source's share says."""
    triples = [(i, "w w w", "a" if i < 40 else "b") for i in range(120)]
    df, seen = make(spark, triples), {}
    for seed in range(5):
        for r in rows(mixing.mix(df, weights=(1, 3), seed=str(seed))):
            seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["copies"]
    first, second = [seen[i] for i in range(40)], [seen[i] for i in range(40, 120)]
    assert sum(first) / 200 == pytest.approx(0.75, abs=0.03) and sum(second) / 400 == pytest.approx(1.125, abs=0.03)
    assert len(set(first)) > 1 and len(set(second)) > 1 and all(5 <= x <= 10 for x in second)


def test_odd_rows(spark):
    triples = [(i, t, None if i % 2 else "x") for i, t in enumerate(ODD_TEXTS)]
    triples += [(None, "no id here", "x"), (None, "no id here", "x"), (3, "again " * 9, "x"), (3, "again " * 9, "x"),
                (4, None, "empty source"), (5, "\n\x0b ", "empty source")]
    check(triples, rows(mixing.mix(make(spark, triples))))
    assert rows(mixing.mix(make(spark, triples).where("false"))) == []
    none = rows(mixing.mix(make(spark, [(1, None, "x"), (2, "", None)])))
    assert {(r["size"], r["target"], r["taken"]) for r in none} == {(0, 0.0, 0)}


def test_plan_has_no_python(spark):
    plan = mixing.mix(make(spark, [(1, "a b", "x")]))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "MapInPandas" not in plan
