import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture(scope="session")
def docs(spark):
    """docs(rows, extra): rows of (doc_id, text), with columns that clash with results."""
    def make(rows, extra=""):
        names = [c for c in extra.split() if c]
        schema = "doc_id long, text string" + "".join(f", {c} string" for c in names)
        return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)

    return make
