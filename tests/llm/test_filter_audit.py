"""Radix tries and the filter audit against direct versions."""

from itertools import permutations

from brute import ODD_TEXTS, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé\x00", max_size=12), st.integers(0, 5)), max_size=40))
def test_trie_holds_every_text_with_its_smallest_id(pairs):
    trie, want = fa.RadixTrie(), {}
    for text, doc in pairs:
        b = text.encode()
        trie.insert(b, doc, "", 0, 1)
        want.setdefault(b, []).append(doc)
    got = {text: (node.least, sorted(d for (d, _), (_, n) in node.held.items() for _ in range(n)))
           for text, node in trie.terminals()}
    assert got == {t: (min(d), sorted(d)) for t, d in want.items()}
    assert trie.bytes <= sum(map(len, want))


def direct(docs, labels):
    failed = []
    for d, t, part in docs:
        t = t or ""
        w = t.encode().split()
        mask = "".join(f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t),
            d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in docs))) if bad)
        failed.append((part or "", mask, any(x == d and q == 1 for x, q, _ in labels if x is not None),
                       any(x == d and y == 1 for x, _, y in labels if x is not None)))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [x[1:] for x in failed if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in m for m, *_ in own) - len(gone), sum(m == f for m, *_ in own),
                    sum(g for _, g, _ in gone), sum(t for *_, t in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels, **options):
    df = spark.createDataFrame([(d, t, p, "x", "x", 1) for d, t, p in docs],
                               "doc_id long, text string, lang string, part string, mask string, place int").repartition(3)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        for r in rows(fa.audit(df, spark.createDataFrame(labels, LABELS), **options))}
    assert got == direct(docs, labels)


def test_audit_with_hot_copies_and_long_common_prefixes(spark):
    long = " ".join(f"word{i}" for i in range(150))
    docs = [(i, long, "en") for i in range(60)]                                     # a third are copies
    docs += [(100 + i, long + f" tail {i % 40}", None if i % 3 else "de") for i in range(60)]
    docs += [(200 + i, "x" * 500 + str(i), "en") for i in range(30)] + [(300 + i, ("A b # " * (i % 9)), "") for i in range(30)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 330, 3)] + [(3, 1, None), (None, 1, 1)]
    check(spark, docs, labels)
    check(spark, docs, labels, range_bytes=400, trie_bytes=700, trie_rows=7, sample=20, prefix=2)


def test_odd_rows(spark):
    docs = [(i, t, "en") for i, t in enumerate(ODD_TEXTS)] + [(i + 50, t, None) for i, t in enumerate(ODD_TEXTS)]
    docs += [(None, "same", "en"), (None, "same", "en"), (7, "same", "en"), (7, "same", "de"), (7, "same", "en"),
             (8, "same", "en"), (-3, "other", "en"), (9, "other", "en"), (9, "unlike", "en")]
    check(spark, docs, [(7, None, 1), (8, 1, 1), (8, 0, 0)])
    check(spark, [], [])


def test_borders_grow_where_texts_begin_alike(spark):
    texts = spark.createDataFrame([("same beginning " * 20 + f"{i:05d}",) for i in range(400)] + [("b",)] * 400, "text string")
    borders = fa.borders_of(texts, 8, sample=1000, prefix=4)
    assert borders == sorted(set(borders)) and max(map(len, borders)) > 300
    from bisect import bisect_right
    sizes = [0] * (len(borders) + 1)
    for i in range(400):
        sizes[bisect_right(borders, ("same beginning " * 20 + f"{i:05d}").encode())] += 1
    assert max(sizes) <= 250
    assert fa.borders_of(texts.where("false"), 8) == [] == fa.borders_of(texts, 1)
