"""Direct versions of the operators' results, for small inputs."""

import hashlib
import re

STRIP = " \t\n\x0b\x0c\r"
ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "word", "two words", "a\x00b \x85 \xa0", "tab\tand\x0bvertical\x0cfeed\r\nline",
    "É é ß İ ẞ ﬀ 日本語 ❤️ 👩‍👩‍👧", "<|endoftext|> </s> <unk> <0x0A> ▁▁ ▁a", "x" * 5000, "long word " * 3000,
    "the same line here\n  THE SAME LINE HERE\t\nother", "the same line here", "  the same line here  \nshort",
]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id"):
    out = {r[key]: r for r in rows(df)}
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode("utf-8", "surrogatepass")).hexdigest()


def words(text):
    return (text or "").encode().lower().split()


def group(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def near_copies(docs, width=2, percent=80):
    sets = {d: shingles(t, width) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = group(ids, links)
    return {d: (len(sets[d]), label[d], label[d] == d) for d in ids}


def _lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def kept_lines(docs):
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = _lower(line.strip(STRIP))
            if len(k) >= 10 and d is not None:
                holders.setdefault(k, set()).add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(h := holders.get(_lower(x.strip(STRIP)), ())) < 2 or min(h) == d]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def cut_passages(docs, n=50):
    first = {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raw):
        b = raw[d]
        for i in range(len(b) - n + 1):
            first.setdefault(b[i:i + n], d)
    out = {}
    for d, b in raw.items():
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] < d:
                gone[i:i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out
