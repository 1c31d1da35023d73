"""Toxicity scores from FTRL-proximal logistic regression.

Features are hashed into 2^20 coordinates: lower-cased words, word pairs
and skip-grams (two words with one between), each present or not.  Training
walks a bounded sample of labelled rows (TRAIN_ROWS, chosen by a hash of the
id, never by position) a few times; every coordinate has its own learning
rate from its own gradient history, and an L1 term keeps most coordinates
at zero.  The sample is featurised once and written; each epoch is one
streamed pass over it, which takes and leaves its state (at most 2^20
coordinates) as a row in the shared folder, so memory depends on neither the
corpus nor the length of its texts.  Scoring broadcasts the non-zero weights (12 bytes
each, at most 12 MB) and reads every whole text once, without a shuffle.

Only texts and their labels are used: language, source and id are no input
of a score.

Defined results: a null or empty text scores the bias alone; rows without a
label or id are not trained on; several labels of one id count as their
largest; without any positive training row every score is near zero and
nothing is predicted toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, hash_words, in_slices, mix, ready, salt, stored, words_of

DIM = 1 << 20
TRAIN_ROWS = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
POSITIVE_WEIGHT = 3.0
_NOTHING_LEARNED = -10.0
_GRAIN = 1_000_000


def coordinates(text: str | None) -> np.ndarray:
    """Hashed coordinates of a text's n-grams and skip-grams, with repeats."""
    h = hash_words(words_of(text))
    parts = [mix(h)]
    for gap, s in ((1, 5), (2, 9)):
        if len(h) > gap:
            parts.append(mix((h[:-gap] + salt(s)) ^ mix(h[gap:])))
    return (np.concatenate(parts) & np.uint64(DIM - 1)).astype(np.int32)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed-form proximal step: zero inside the L1 ball."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _bias(z: float, n: float) -> float:
    return -z / ((BETA + math.sqrt(n)) / ALPHA)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        ids, ys, texts = columns_of(batch, "id", "y", "text")
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(ys, pa.int32()),
            pa.array([np.unique(coordinates(t)).tobytes() for t in texts], pa.binary())], names=["id", "y", "at"])


_STATE = "turn long, id long, y int, at binary, z binary, n binary, bz double, bn double"


def _epoch(last: bool):
    """One pass of the online learner over its partition's rows in order.  The
    row without a label holds the state so far and comes first; the pass
    yields the new state, or after the last epoch the non-zero weights (in
    z) and the bias."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n, bz, bn = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
        for batch in batches:
            for y, at, z0, n0, bz0, bn0 in zip(*columns_of(batch, "y", "at", "z", "n", "bz", "bn")):
                f = np.frombuffer(at, np.int32)
                if y is None:
                    z[f], n[f] = np.frombuffer(z0, np.float32), np.frombuffer(n0, np.float32)
                    bz, bn = bz0, bn0
                    continue
                zi, ni, w, wb = z[f], n[f], weights(z[f], n[f]), _bias(bz, bn)
                g = float(_sigmoid(w.sum() + wb) - y) * (POSITIVE_WEIGHT if y else 1.0)
                z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[f] = ni + g * g
                bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ALPHA * wb
                bn += g * g
        if last:
            z, bz = weights(z, n), _bias(bz, bn)
            n = z
        at = np.flatnonzero(n).astype(np.int32)
        yield pa.RecordBatch.from_pydict({
            "turn": [-(1 << 63)], "id": [None], "y": [None], "at": [at.tobytes()],
            "z": [z[at].astype(np.float64 if last else np.float32).tobytes()],
            "n": [n[at].astype(np.float32).tobytes()], "bz": [float(bz)], "bn": [float(bn)]}, schema=pa.schema(
                [("turn", pa.int64()), ("id", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("z", pa.binary()),
                 ("n", pa.binary()), ("bz", pa.float64()), ("bn", pa.float64())]))
    return run


def held_out(id_col: str | Column) -> Column:
    """The fold that no label is learned from: crc32(id as text) mod 5 = 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", train_rows: int = TRAIN_ROWS,
          epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) learned from labelled rows outside the held-out fold."""
    spark = ready(docs)
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id"))
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    total = usable.count()
    share = _GRAIN if total <= train_rows else max(1, _GRAIN * train_rows // total)
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(_GRAIN)) < share)
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), "text")
            .join(F.broadcast(sample), "id")   # about train_rows rows of 12 bytes
            .mapInArrow(_featurise, "id long, y int, at binary"))
    rows = stored(rows, "features")
    seen = rows.agg(F.max("y")).head()[0]
    if not seen:
        return np.empty(0, np.int32), np.empty(0), _NOTHING_LEARNED
    none, state = F.lit(None).cast("binary"), None
    for epoch in range(epochs):
        turn = rows.select(F.xxhash64("id", F.lit(100 + epoch)).alias("turn"), "id", "y", "at", none.alias("z"),
                           none.alias("n"), F.lit(0.0).alias("bz"), F.lit(0.0).alias("bn"))
        last = epoch == epochs - 1
        state = stored((turn if state is None else turn.unionByName(state)).repartition(1)
                       .sortWithinPartitions("turn", "id", F.xxhash64("at")).mapInArrow(_epoch(last), _STATE), "learner")
    got = state.head()
    return np.frombuffer(got["at"], np.int32), np.frombuffer(got["z"]), got["bz"]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        dense = np.zeros(DIM)
        dense[at] = w
        live = dense != 0
        for batch in in_slices(batches, "__text"):
            scores = []
            for text in batch.column(batch.schema.get_field_index("__text")).to_pylist():
                f = coordinates(text)
                scores.append(float(_sigmoid(dense[np.unique(f[live[f]])].sum() + bias)))
            cols = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            out = batch.select(cols)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(scores, pa.float64())],
                                             names=[*out.schema.names, "__score"])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """The columns named by `keep` (all by default) and `__score`, 0 to 1."""
    spark = ready(docs)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["`__score` double"])
    held = spark.sparkContext.broadcast(model)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(_score(held), schema)
