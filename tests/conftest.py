import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from linelift.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="linelift-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables_small(spark):
    from linelift.sources.tpch import load_tables

    return load_tables(spark, SF_SMALL)
