"""Numeric codes and display labels for status, trend and health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _case(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def status_code(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _case(c, S.STATUS_CODES, -1).cast("int")


def trend_code(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _case(c, S.TREND_CODES, 0).cast("int")


def health_code(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _case(c, S.HEALTH_CODES, -1).cast("int")


def health_from_code(col: Column) -> Column:
    inv = {v: k for k, v in S.HEALTH_CODES.items()}
    return _case(col, inv, None)


def label_of(code: Column, labels: dict) -> Column:
    return _case(code, labels, None)


def status_label(code: Column) -> Column:
    return label_of(code, S.STATUS_LABELS)


def trend_label(code: Column) -> Column:
    return label_of(code, S.TREND_LABELS)


def health_label(code: Column) -> Column:
    return label_of(code, S.HEALTH_LABELS)


def code_filter(code: Column, pattern: str) -> Column:
    """Dashboard variable filter such as `.*`, `0` or `[1-4]`; the
    pattern is anchored like a label matcher."""
    return code.cast("string").rlike("^(?:" + pattern + ")$")

