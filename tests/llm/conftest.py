import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use for results."""
    def make(pairs, extra=True):
        df = spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, "s", len(t or "")) for d, t in pairs], SCHEMA)
        if extra:
            for name in ("id", "n", "kept", "block", "component_id", "n_lines", "ids", "shard", "score", "length"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)
    return make
