"""Scalar helpers: duration text, truncation, codes, key text."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions.codes import code_filter, health_code, status_code, trend_code
from tidewater.functions.timefn import truncate_from_year_one_s


@pytest.mark.parametrize("secs,txt", [(0, "0s"), (0.4, "0s"), (45, "45s"), (44.5, "45s"), (90, "1m30s"),
                                      (7200, "2h0m0s"), (3725, "1h2m5s")])
def test_duration_rounded(spark, secs, txt):
    assert spark.range(1).select(X.duration_text_rounded(F.lit(float(secs)))).first()[0] == txt


@pytest.mark.parametrize("us,txt", [(0, "0s"), (750, "750µs"), (1500, "1.5ms"), (60_500_000, "1m0.5s"),
                                    (10_800_000_000, "3h0m0s"), (2_000_000, "2s")])
def test_duration_raw(spark, us, txt):
    assert spark.range(1).select(X.duration_text_us(F.lit(us).cast("long"))).first()[0] == txt


def test_truncate_from_year_one(spark):
    # 5 min divides the year-one offset: same as epoch bucketing
    ts = 1_700_000_123 * 1_000_000
    r = spark.range(1).select(truncate_from_year_one_s(F.lit(ts), 300).alias("a"),
                              truncate_from_year_one_s(F.lit(ts), 420).alias("b")).first()
    assert r.a == 1_700_000_123 // 300 * 300
    y1 = 62135596800
    assert r.b == (1_700_000_123 + y1) // 420 * 420 - y1 and r.b != 1_700_000_123 // 420 * 420


def test_codes_and_filter(spark):
    r = spark.range(1).select(status_code(F.lit("STOPPED")), status_code(F.lit("X")), trend_code(F.lit("STABLE")),
                              health_code(F.lit("CRITICAL")), code_filter(F.lit(3), "[1-4]"),
                              code_filter(F.lit(0), "[1-4]"), code_filter(F.lit(-1), ".*")).first()
    assert tuple(r) == (3, -1, 1, 2, True, False, True)


def test_key_text_split_at_first_slash(spark):
    c, g = X.split_key_text(F.lit("prod/team/a"))
    assert tuple(spark.range(1).select(c, g).first()) == ("prod", "team/a")


def test_truncate_accepts_integer_windows(spark):
    # an integer window (10800 s) must not overflow INT arithmetic under ANSI
    ts = 1_700_000_123 * 1_000_000
    r = spark.range(1).select(truncate_from_year_one_s(F.lit(ts), 3 * 3600).alias("a")).first()
    assert r.a == (1_700_000_123 + 62135596800) // 10800 * 10800 - 62135596800
