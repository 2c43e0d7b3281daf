"""

sf0.001 always; sf0.01 as well when LINELIFT_ORACLE_SF001=1 (the driver's own
check runs there).
"""

import os

import pytest

import __spark_entry__ as entry
from fixtures import SF_MEDIUM, SF_SMALL
from linelift.plans.catalog import QUERIES as CATALOG
from oracle_compare import compare, duck_connect

QUERIES = {n: f for n, f in entry.queries().items() if n in CATALOG}
ORACLE = {n: s for n, s in entry.oracle_sql().items() if n in CATALOG}
DIRS = [SF_SMALL] + ([SF_MEDIUM] if os.environ.get("LINELIFT_ORACLE_SF001") == "1" else [])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) == set(CATALOG) and len(QUERIES) >= 9 + 23


@pytest.fixture(scope="module", params=DIRS)
def sf_dir(request):
    return request.param


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duck_connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    problems = compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    assert not problems, "\n".join(problems)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and df.columns[:2] == ["bureau_hit", "risk_label"]
