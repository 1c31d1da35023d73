"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts come from each whole text in one pass.  On top of the fixed
base rules, graded rules (RULES: a ratio of counts, too high) reject a
document when its ratio exceeds a cutoff chosen per stratum (language):

* Labelled good documents that pass the base rules are the holdout.  For
  every stratum, rule and cutoff, k of the stratum's n good documents would
  be rejected; the exact binomial tail P(Bin(n, alpha) <= k) is the p-value
  of "this cutoff rejects more than alpha of the good documents".
* Cutoffs are tested from the loosest on and the first failure ends a rule
  (fixed-sequence testing), each sequence at delta / (strata * rules)
  (Bonferroni), with alpha split evenly over the rules.  So with confidence
  1 - delta no stratum loses more than ALPHA of its good documents to the
  graded rules.  A stratum with too few labels keeps all.

The binomial tail is summed from k downwards in logarithms; what lies beyond
TERMS terms is bounded by its geometric series, so the p-value is never too
small.

Defined results: null or empty text has zero counts and fails the base rule;
a null language is a stratum of its own; a null doc_id is judged but never
matches a label; several labels of one id count as good if any is; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ALPHA, DELTA = 0.02, 0.05
TERMS = 4000
WINDOW = 5
_SPACE = " \t\n\x0b\x0c\r"

#: rule -> (count, cutoffs of count / n_words from loosest to tightest)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols", [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08]),
    "dup_lines": ("n_dup_lines", [0.2, 0.15, 0.1, 0.07, 0.05, 0.035, 0.025, 0.018]),
    "repeats": ("n_repeat_words", [0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05]),
    "long_words": ("word_chars", [30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0]),
}


def with_counts(docs: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns `keep`, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed.

    Each step is a projection of its own because the next one reads its
    array several times.  Five-word windows are compared by 64-bit hashes;
    only texts with a repeated window sort them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE))
    step = docs.select(
        *keep, text.alias("__text"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("__w"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "").alias("__lines"))
    step = step.select(
        *keep, F.size("__w").alias("__n"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    counts = ["word_chars", "n_symbols", "n_dup_lines"]
    step = step.select(*keep, *counts, "__n", F.when(
        F.col("__n") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW),
                    lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("__win"))
    step = step.select(*keep, *counts, "__n", F.when(
        F.size(F.array_distinct("__win")) < F.size("__win"),
        F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__sorted"))
    step = step.select(*keep, *counts, "__n", F.sort_array(F.transform(
        F.filter("__sorted", lambda x, i: F.coalesce(F.get("__sorted", i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get("__sorted", i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])).alias("__starts"))
    covered = F.aggregate(
        F.transform("__starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", i + 1) - p,
                                                                               F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return (step.select(*keep, F.col("__n").cast("long").alias("n_words"), *counts, covered.alias("n_repeat_words"))
            .withColumn("base_failed", (F.col("n_words") < 10)
                        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))


def _lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, shifted back."""
    y = x + 8
    series = ((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5))
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    return series - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), or a little more; 1 where k >= n * p."""
    kd, nd, odds = k.cast("double"), n.cast("double"), (1 - p) / p
    top = F.exp(_lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    start = F.struct(top.alias("t"), top.alias("s"))
    def more(acc, j):
        t = acc["t"] * (kd - j + 1) / (nd - kd + j) * odds
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
    def done(acc):
        left = kd - F.least(kd, F.lit(float(TERMS)))
        ratio = left / (nd - left + 1) * odds
        return acc["s"] + F.when(left > 0, acc["t"] * ratio / (1 - ratio)).otherwise(0.0)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(TERMS).cast("long")))).otherwise(
        F.array().cast("array<bigint>"))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, more, done)))


def thresholds(counts: DataFrame, labels: DataFrame, *, stratum: str, alpha: float = ALPHA, delta: float = DELTA,
               rules: dict[str, tuple[str, list[float]]] = RULES) -> DataFrame:
    """One row per stratum with good labels: stratum and, per rule, the
    tightest cutoff that is safe (null: none)."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc_id"))
            .agg(F.max("quality").alias("good")).where("good = 1").select("doc_id"))
    held = counts.where("not base_failed").join(good, "doc_id", "left_semi")
    def exceeded(col: str, cuts: list[float]) -> Column:
        return sum((F.col(col) / F.col("n_words") > c).cast("int") for c in cuts)
    # per document and rule, the index of the loosest cutoff (they are sorted) that rejects it
    first = held.select(F.col(stratum).alias("__s"), *[
        (F.lit(len(cuts)) - exceeded(col, cuts)).alias(r) for r, (col, cuts) in rules.items()])
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cut"),
                              F.lit(len(cuts)).alias("m")) for r, (_, cuts) in rules.items()
                     for i, c in enumerate(cuts)])
    sums = first.groupBy("__s").agg(F.count("*").alias("n"), *[
        F.sum((F.col(r) <= i).cast("long")).alias(f"{r}_{i}") for r, (_, cuts) in rules.items()
        for i in range(len(cuts))])
    sums = stored(sums, "calibration")
    tests = sums.withColumn("strata", sums.agg(F.count("*")).scalar())
    k = F.coalesce(*[F.when((F.col("g.rule") == r) & (F.col("g.i") == i), F.col(f"{r}_{i}"))
                     for r, (_, cuts) in rules.items() for i in range(len(cuts))])
    tests = tests.withColumn("g", F.explode(grid)).select("__s", "n", "strata", "g.*", k.alias("k"))
    safe = binomial_tail(F.col("k"), F.col("n"), alpha / len(rules)) <= delta / (F.col("strata") * len(rules))
    upto = Window.partitionBy("__s", "rule").orderBy("i")
    chosen = (tests.withColumn("safe", F.min(safe.cast("int")).over(upto)).where("safe = 1")
              .groupBy("__s", "rule").agg(F.min("cut").alias("cut")))
    return chosen.groupBy("__s").pivot("rule", list(rules)).agg(F.min("cut"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
          rules: dict[str, tuple[str, list[float]]] = RULES) -> DataFrame:
    """Per document: doc_id, stratum, the counts, base_failed, rejected_by
    (names of the graded rules that reject it) and kept."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00none")).alias("stratum"))
    counts = stored(with_counts(src, keep=["doc_id", "stratum"]), "quality-counts")
    cut = stored(thresholds(counts, labels, stratum="stratum", alpha=alpha, delta=delta, rules=rules), "thresholds")
    joined = counts.join(cut.withColumnRenamed("__s", "stratum"), "stratum", "left")   # one row per stratum
    rejected = F.filter(F.array(*[F.when((F.col("n_words") > 0) & (F.col(col) / F.col("n_words") > F.col(r)), F.lit(r))
                                  for r, (col, _) in rules.items()]), lambda r: r.isNotNull())
    return (joined.withColumn("rejected_by", rejected)
            .select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept")))
