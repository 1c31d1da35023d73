"""SentencePiece encoding and decoding with batched numpy dynamic programming.

A text is normalised as its model says (identity normaliser, spaces become
U+2581, one in front) and cut where a piece can't reach across, before each
run of U+2581.  Distinct words of equal length advance together: for every
end position, hashes of the substrings that end there probe the model's
sorted piece keys, and one vectorised choice per position stores
backpointers.

* A unigram model takes the Viterbi maximum of summed scores.
* A BPE model has one encoding per prefix, and it extends the encoding of a
  shorter prefix by one piece.  So the same pass applies with another
  choice: the piece whose seam with the piece before it no merge would
  cross.  A seam holds if no symbol on the right edge of the left piece's
  merge tree and none on the left edge of the right one's are adjacent at a
  time when their union, a piece of better rank than both their parents,
  would be merged.  This gives the library's ids exactly; the plain sum of
  BPE scores would not.

Characters outside the vocabulary become byte pieces.  Words already seen by
a worker come from a bounded table.  Words longer than LONG characters (text
without spaces) take the same recurrence one position at a time.

Defined results: null and empty texts have no ids; decoding null gives null;
ids outside the model decode to nothing; U+2581 in a text reads back as a
space, everything else reads back exactly; an empty table gives an empty
result; columns beside the text pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import in_slices, mix, ready

SPACE = "▁"
LONG = 40
_BATCH = 4096
_TABLE = 1 << 20            # seams remembered by a worker
_WORDS = 400_000            # words remembered by a worker
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNIGRAM, BPE = 1, 2
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_FAR = 1 << 40


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces, scores and merge trees of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, train = m.normalizer_spec, m.trainer_spec
        if not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("models need byte fallback, the identity normaliser and U+2581 as a prefix")
        if train.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        del sentencepiece
        self.kind, self.prefix = train.model_type, norm.add_dummy_prefix
        kinds = proto.ModelProto.SentencePiece
        self.size = len(m.pieces)
        self.pieces = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = np.array([p.score for p in m.pieces], np.float64)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.ascii = np.array([self.byte_ids[b] for b in range(128)], np.int64)
        self.output = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
            else p.piece.replace(SPACE, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED)
            else " ⁇ ".encode() if p.type == kinds.UNKNOWN else b"" for p in m.pieces]
        self.outputs = pa.array([*self.output, b""], pa.binary())
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.word = self._word_pattern()
        if any(p.type == kinds.USER_DEFINED for p in m.pieces) and self.kind == BPE:
            raise ValueError("user-defined pieces are not supported in BPE models")
        # runs of spaces merge after everything else in BPE models, so they are encoded apart
        self.runs: dict[int, bytes] = {}
        spaces = {p: i for p, i in self.ids.items() if len(p) > 1 and not p.strip(SPACE)}
        if self.kind == BPE and spaces:
            rest = [i for p, i in self.ids.items() if len(p) > 1 and p not in spaces]
            if self.scores[list(spaces.values())].max() >= self.scores[rest].min():
                raise ValueError("runs of spaces must merge last")
            self.whole_run = max(map(len, spaces))
            self.runs = {k: self._run(k) for k in range(1, self.whole_run + 1)}
            self.ids = {p: i for p, i in self.ids.items() if p not in spaces}
        # the keys that substrings probe
        keys = np.array([_hash_text(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(self.ids.values(), np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)           # most substrings are no piece; this says so without a search
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.chars = np.zeros((self.size + 1, self.longest), np.uint32)
        for piece, i in self.ids.items():
            self.chars[i, :len(piece)] = [ord(c) for c in piece]
        self.unknown = self.size                       # stands for a character outside the vocabulary
        known = self.scores[list(self.ids.values())]
        self.unknown_score = known.min().astype(np.float32) - np.float32(10)
        self.singles = np.append(self.scores, self.unknown_score).astype(np.float32)   # paths add up in single precision, as in the library
        if self.kind == BPE:
            self._merge_trees()
        self.words: dict[str, bytes] = {}
        self.seam_key = np.full(_TABLE, -1, np.int64)
        self.seam_ok = np.zeros(_TABLE, bool)
        self.seams: dict[tuple[int, int], bool] = {}

    def _word_pattern(self) -> re.Pattern:
        """Cuts a text where no piece reaches across: before spaces, around line
        ends if they are unknown, and between a letter and a mark (ASCII
        punctuation) that no piece has after a letter."""
        letter = re.compile(_LETTER)
        after = {b for p in self.ids for a, b in zip(p, p[1:]) if letter.fullmatch(a)}
        marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        parts = [f"{SPACE}*+{_LETTER}++(?=[{re.escape(marks)}])"] * bool(marks) + [
            f"{SPACE}++[^{SPACE}{line}]*+", f"[^{SPACE}{line}]++"] + ["\n++"] * bool(line)
        return re.compile("|".join(parts))

    # -- BPE ----------------------------------------------------------------------

    def _run(self, k: int) -> bytes:
        """Ids of k spaces alone, merge by merge: best score, then leftmost."""
        symbols = [SPACE] * k
        while True:
            best = max(((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                        if a + b in self.ids), default=None)
            if best is None:
                return np.array([self.ids[x] for x in symbols], "<i4").tobytes()
            i = -best[1]
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]

    def _spaced(self, word: str, encode) -> bytes:
        """A word with two or more spaces in front: the last one goes with the
        text if a piece takes it, the others are a run."""
        k = len(word) - len(word.lstrip(SPACE))
        tail = encode(word[k - 1:]) if k < len(word) else b""
        alone = self.runs[1]
        if tail and tail[:4] != alone:
            k -= 1
        elif tail:
            tail = tail[4:]
        whole, rest = divmod(k, self.whole_run)
        return self.runs[self.whole_run] * whole + self.runs.get(rest, b"") + tail

    def _merge_trees(self) -> None:
        """Last merge of every piece, and the edges of its merge tree."""
        n = self.size + 1
        self.rank = np.full(n, -1, np.int64)           # single characters exist from the start
        by_score = {s: r for r, s in enumerate(sorted({float(self.scores[i]) for i in self.ids.values()}, reverse=True))}
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs = {}
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.rank[i] = by_score[float(self.scores[i])]
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = by_score[float(self.scores[i])]
        for piece, i in self.ids.items():
            if len(piece) > 1 and (got := self._merge(piece)) is not None:
                left[i], right[i] = got
                if max(self.rank[left[i]], self.rank[right[i]]) >= self.rank[i]:
                    raise ValueError("merges out of order")
        self.merged = (left >= 0) | (self.rank < 0)    # pieces that BPE can produce
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_rank = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.pairs = pairs

        def edge(child):
            """(piece, rank from which it exists, rank at which it is gone) down one edge."""
            nodes, until = [np.arange(n)], [np.full(n, _FAR)]
            while True:
                down = np.where(nodes[-1] >= 0, child[nodes[-1]], -1)
                if (down < 0).all():
                    return np.stack(nodes, 1), np.stack(until, 1)
                until.append(np.where(down >= 0, self.rank[nodes[-1]], -1))
                nodes.append(down)
        self.right_edge, self.right_until = edge(right)
        self.left_edge, self.left_until = edge(left)

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """The last merge when `piece` alone is encoded, or None if it isn't
        one piece then."""
        symbols, last = list(piece), None
        while len(symbols) > 1:
            best = max(((self.scores[self.ids[a + b]], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))
                        if a + b in self.ids), default=None)
            if best is None:
                return None
            k = -best[1]
            last = (self.ids.get(symbols[k], self.unknown), self.ids.get(symbols[k + 1], self.unknown))
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
        return last

    def _compute_seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b stay apart when a + b is encoded."""
        ok, n = np.ones(len(a), bool), self.size + 1
        for d in range(self.right_edge.shape[1]):
            x, x_until = self.right_edge[a, d], self.right_until[a, d]
            if not (x >= 0).any():
                break
            for e in range(self.left_edge.shape[1]):
                y, y_until = self.left_edge[b, e], self.left_until[b, e]
                at = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(at):
                    break
                key = x[at] * n + y[at]
                k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
                hit = self.pair_key[k] == key
                at, rank = at[hit], self.pair_rank[k[hit]]
                when = np.maximum(rank, np.maximum(self.rank[x[at]], self.rank[y[at]]))
                # of equal merges the leftmost goes first
                ok[at[(when < x_until[at]) & (when <= np.where(rank == y_until[at], y_until[at], y_until[at] - 1))]] = False
        return ok

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_compute_seams` through a table of bounded size."""
        key = a * (self.size + 1) + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(_TABLE - 1)).astype(np.int64)
        out = self.seam_ok[slot]
        miss = np.flatnonzero(self.seam_key[slot] != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = self._compute_seams(fresh // (self.size + 1), fresh % (self.size + 1))
            out[miss] = ok[back]
            self.seam_key[slot[miss]], self.seam_ok[slot[miss]] = key[miss], ok[back]
        return out

    # -- the recurrence -------------------------------------------------------------

    def encode_equal(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32 bit) of words of one length, together."""
        n, size = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        prefix = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            prefix[:, i + 1] = prefix[:, i] * _BASE + chars[:, i] + np.uint64(1)
        widest = min(size, self.longest)
        found = np.full((size + 1, widest + 1, n), -1, np.int64)   # [end, length]: the piece
        for m in range(1, widest + 1):
            h = (prefix[:, m:] - prefix[:, :-m] * _power(m)).T
            end, row = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            h = h[end, row]
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[k] == h
            found[end[hit] + m, m, row[hit]] = self.values[k[hit]]
        found[1:, 1] = np.where(found[1:, 1] < 0, self.unknown, found[1:, 1])
        back = np.zeros((size + 1, n), np.int64)                   # length of the last piece of each prefix
        last = np.zeros((size + 1, n), np.int64)
        rows = np.arange(n)
        if self.kind == UNIGRAM:
            scores, best = self.singles, np.zeros((size + 1, n), np.float32)
            for i in range(1, size + 1):
                m = np.arange(min(i, widest), 0, -1)
                cand = found[i, m]
                total = np.where(cand >= 0, best[i - m] + scores[cand], -np.inf)
                k = total.argmax(0)
                best[i], back[i], last[i] = total[k, rows], m[k], cand[k, rows]
        else:
            for i in range(1, size + 1):
                m = np.arange(min(i, widest), 0, -1)
                cand = found[i, m]
                ok = (cand >= 0) & self.merged[cand]
                seam = ok & (m < i)[:, None]
                p, r = np.nonzero(seam)
                ok[p, r] = self.apart(last[i - m[p], r], cand[p, r])
                k = ok.argmax(0)
                back[i], last[i] = m[k], cand[k, rows]
        # follow the backpointers, all words together, from the right
        ids, at = np.full((n, size), -1, np.int64), np.full(n, size)
        bad, wide, col = np.zeros(n, bool), np.zeros(n, bool), size
        live = rows
        while len(live):
            col -= 1
            end = at[live]
            piece, m = last[end, live], back[end, live]
            ids[live, col] = piece
            for width in range(1, widest + 1):                     # the hash was right if the characters agree
                own = np.flatnonzero((m == width) & (piece != self.unknown))
                if len(own):
                    cut = chars[live[own, None], end[own, None] - width + np.arange(width)]
                    bad[live[own]] |= (cut != self.chars[piece[own], :width]).any(1)
            own = np.flatnonzero(piece == self.unknown)             # an ASCII character is one byte piece
            char = chars[live[own], end[own] - 1]
            ids[live[own], col] = np.where(char < 128, self.ascii[np.minimum(char, 127)], self.size + char)
            wide[live[own]] |= char >= 128
            at[live] = end - m
            live = live[at[live] > 0]
        use = ids >= 0
        ends = 4 * np.cumsum(use.sum(1))
        raw = ids[use].astype("<i4").tobytes()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero(wide).tolist():
            row = ids[i][use[i]].tolist()
            out[i] = np.array([j for c in row for j in ([c] if c < self.size else [
                self.byte_ids[b] for b in chr(c - self.size).encode("utf-8", "surrogatepass")])], "<i4").tobytes()
        for i in np.flatnonzero(bad).tolist():
            out[i] = self.encode_long(words[i])
        return out

    def encode_long(self, word: str) -> bytes:
        """The same recurrence for one word of any length."""
        back, last = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        best, scores = [np.float32(0)] * (len(word) + 1), self.singles
        for i in range(1, len(word) + 1):
            top = None
            for m in range(min(i, self.longest), 0, -1):
                piece = self.ids.get(word[i - m:i])
                if piece is None:
                    if m > 1:
                        continue
                    piece = self.unknown
                if self.kind == UNIGRAM:
                    s = best[i - m] + scores[piece]
                    if top is None or s > top:
                        top, back[i], last[i] = s, m, piece
                elif self.merged[piece] and (m == i or self._apart(last[i - m], piece)):
                    back[i], last[i] = m, piece
                    break
            best[i] = best[0] if top is None else top
        ids, at = [], len(word)
        while at > 0:
            if last[at] == self.unknown:
                ids += [self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(last[at])
            at -= back[at]
        return np.array(ids[::-1], "<i4").tobytes()

    def _apart(self, a: int, b: int) -> bool:
        got = self.seams.get((a, b))
        if got is None:
            if len(self.seams) >= _TABLE:
                self.seams.clear()
            got = self.seams[a, b] = bool(self._compute_seams(np.array([a]), np.array([b]))[0])
        return got

    # -- texts -----------------------------------------------------------------------

    def _learn(self, words: set[str]) -> None:
        """Put the words' ids into the table of known words."""
        if len(self.words) > _WORDS:
            self.words.clear()
        known, fresh = self.words, {}
        new = words.difference(known)
        spaced = {w for w in new if w.startswith(SPACE + SPACE)} if self.runs else set()
        new -= spaced
        new.update({SPACE + w.lstrip(SPACE) for w in spaced if w.strip(SPACE)}.difference(known))
        for w in new:
            fresh.setdefault(len(w), []).append(w)
        for size, group in fresh.items():
            for a in range(0, len(group), _BATCH):
                part = group[a:a + _BATCH]
                known.update(zip(part, self.encode_equal(part) if size <= LONG else map(self.encode_long, part)))
        known.update([(w, self._spaced(w, known.__getitem__)) for w in spaced])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, little-endian 32 bit."""
        split = []
        for text in texts:
            s = (text or "").replace(" ", SPACE)
            split.append(self.word.findall(SPACE + s if s and self.prefix else s))
        self._learn(set().union(*split))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of a column of texts.  Texts with single spaces only are split
        and their words told apart by Arrow, so Python sees each distinct
        word of the column once; the others are cut by `encode`."""
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.invert(pc.match_substring_regex(texts, f"^ | $|  |{SPACE}")), pc.not_equal(texts, ""))
        if not self.prefix:
            plain = pc.and_(plain, False)
        odd = _lists(self.encode(texts.filter(pc.invert(plain)).to_pylist()))
        split = pc.split_pattern(texts.filter(plain), " ")
        coded = split.flatten().dictionary_encode()
        words = [SPACE + w for w in coded.dictionary.to_pylist()]
        cut = [self.word.findall(w) if _MARKED.search(w) else [w] for w in words]
        self._learn(set().union(*cut))
        known = self.words
        distinct = _lists([known[c[0]] if len(c) == 1 else b"".join([known[x] for x in c]) for c in cut])
        each = distinct.take(coded.indices)
        ends = each.offsets.take(split.offsets)
        even = pa.ListArray.from_arrays(pc.subtract(ends, ends[0]) if len(ends) else ends, each.flatten())
        where = np.empty(len(texts), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        where[is_plain] = np.arange(is_plain.sum())
        where[~is_plain] = is_plain.sum() + np.arange((~is_plain).sum())
        return pa.concat_arrays([even, odd]).take(pa.array(where))

    def decode(self, ids) -> str:
        """The text of ids; the space in front that encoding adds is left off."""
        return self.decode_array(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()

    def decode_array(self, lists: pa.ListArray) -> pa.Array:
        """Texts of a column of ids (null for null)."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        at = pc.subtract(lists.offsets, lists.offsets[0])
        raw = pc.binary_join(pa.ListArray.from_arrays(at, self.outputs.take(pa.array(ids))), b"")
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:                                    # ids that spell no UTF-8
            text = pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())
        if self.prefix:
            text = pc.replace_substring_regex(text, "^ ", "", max_replacements=1)
        return pc.if_else(lists.is_valid(), text, None)


_MARKED = re.compile(r"[^\w▁]")


def _lists(raw: list[bytes]) -> pa.ListArray:
    at = np.cumsum([0] + [len(r) // 4 for r in raw], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _hash_text(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _power(m: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), m, 1 << 64))


@lru_cache(maxsize=2)
def load(path: str | None = None) -> Model:
    """The model of a worker process; `path` must be valid on every worker."""
    return Model(path or default_model())


def _with_column(batch: pa.RecordBatch, drop: str, name: str, column: pa.Array) -> pa.RecordBatch:
    out = batch.select([n for n in batch.schema.names if n != drop])
    return pa.RecordBatch.from_arrays([*out.columns, column], names=[*out.schema.names, name])


def encode(docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids", model: str | None = None,
           keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """The columns named by `keep` (all by default) and the texts' ids; with
    `decoded_col`, also what `decode` gives for them, in the same pass."""
    ready(docs)
    rows = docs.select(*(docs.columns if keep is None else keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in in_slices(batches, "__text", 4 << 20):
            ids = m.encode_array(batch.column(batch.schema.get_field_index("__text")))
            out = _with_column(batch, "__text", ids_col, ids)
            yield _with_column(out, "", decoded_col, m.decode_array(ids)) if decoded_col else out
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{ids_col}` array<int>"]
                       + [f"`{decoded_col}` string"] * bool(decoded_col))
    return docs.select(*rows.columns, docs[text_col].alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, *, ids_col: str = "ids", text_col: str = "decoded", model: str | None = None,
           ) -> DataFrame:
    """All columns, and the text of the ids."""
    ready(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield _with_column(part, "", text_col, m.decode_array(pa.concat_arrays(
                    [part.column(part.schema.get_field_index(ids_col))])))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{text_col}` string"])
    return rows.mapInArrow(run, schema)
