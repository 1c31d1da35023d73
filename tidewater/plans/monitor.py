"""End-to-end batch plans over the bridges: samples -> status -> rollups.

These are the building blocks of the registered queries; each returns a
DataFrame.  Building one writes the bridges' pre-aggregates and takes the
hot-key decision, whose bounded list is all that reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..config import A_WEEKLY, B_LONG, Thresholds
from ..operators.evaluate import evaluate
from ..operators.incidents import detect, event_records, splits
from ..operators.rollup import group_status
from ..sources.bridges import events_samples, orders_samples
from ..operators.skew import HotKeys, plan_hot_keys
from ..sources.positions import join_watermarks, samples_from

# Skew policy of the end-to-end plans: split keys that hold more than one
# shuffle partition's fair share (decided by one small aggregate job; the
# plain plan is used when no key is that hot).
SKEW = "auto"


def written(df: DataFrame, name: str) -> DataFrame:
    return session.written(df, f"{name}-{uuid.uuid4().hex}")


def samples_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, wm = events_samples(spark, sf_dir)
    return join_watermarks(pos, wm)


def samples_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_from(orders_samples(spark, sf_dir))


def evaluated_b_hot(spark: SparkSession, sf_dir: str, th: Thresholds = B_LONG,
                    messages: bool = True) -> tuple[DataFrame, HotKeys]:
    """Evaluated Bridge B plus the hot-key decision, to hand to `detect`."""
    s = written(samples_b(spark, sf_dir), "samples")  # read by the decision and by the evaluation
    hot = plan_hot_keys(s, SKEW)
    return evaluate(s, th, messages=messages, hot_key_rows=hot), hot


def evaluated_a_hot(spark: SparkSession, sf_dir: str, th: Thresholds = A_WEEKLY,
                    messages: bool = True) -> tuple[DataFrame, HotKeys]:
    s = written(samples_a(spark, sf_dir), "samples")
    hot = plan_hot_keys(s, SKEW)
    return evaluate(s, th, messages=messages, hot_key_rows=hot), hot


def evaluated_b(spark: SparkSession, sf_dir: str, th: Thresholds = B_LONG, messages: bool = True) -> DataFrame:
    return evaluated_b_hot(spark, sf_dir, th, messages)[0]


def evaluated_a(spark: SparkSession, sf_dir: str, th: Thresholds = A_WEEKLY, messages: bool = True) -> DataFrame:
    return evaluated_a_hot(spark, sf_dir, th, messages)[0]


def events_of(ev: DataFrame, hot: HotKeys, th: Thresholds | DataFrame) -> DataFrame:
    """Event records (E1-E6) of evaluated rows: one pass, unless hot keys are
    split; the split fold and the payload join then read the rows as written once."""
    if splits(hot):
        ev = written(ev, "status")
    return event_records(ev, detect(ev, th, hot, payload=True), th)


def members_from_positions(pos: DataFrame) -> DataFrame:
    """Group member counts: one consumer per partition the group has ever
    committed to (derived from the positions)."""
    return (pos.filter(F.col("committed_offset").isNotNull())
            .groupBy("cluster", "group_id").agg(F.count_distinct("partition").cast("int").alias("members")))


def groups_b(spark: SparkSession, sf_dir: str, th: Thresholds = B_LONG) -> DataFrame:
    """Group rollup of Bridge B; the evaluation and the member counts share
    one build of the bridge."""
    pos, wm = events_samples(spark, sf_dir)
    ev = evaluate(join_watermarks(pos, wm), th, messages=False, hot_key_rows=SKEW)
    return group_status(ev, members_from_positions(pos))

