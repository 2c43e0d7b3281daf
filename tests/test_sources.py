"""The derived portfolio tables match the counts FIXTURES.md records, and
honour the model's keys (which the batch mode and the R4 rewrite rely on)."""

import pytest
from pyspark.sql import functions as F

from fixtures import SF_MEDIUM, SF_SMALL
from linelift.sources.schema import check_keys
from linelift.sources.tpch import load_tables

# FIXTURES.md section 2, "rows accounts / account_month / profit_month / applications".
EXPECTED = {
    SF_SMALL: {"accounts": 145, "account_month": 4664, "profit_month": 2647, "applications": 1500},
    SF_MEDIUM: {"accounts": 1429, "account_month": 46414, "profit_month": 26212,
                "applications": 15000},
}


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_MEDIUM])
def test_row_counts_match_fixtures(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    assert {n: df.count() for n, df in t.as_dict().items()} == EXPECTED[sf_dir]


def test_model_keys_hold(spark, tables_small):
    assert check_keys(tables_small) == {"accounts": 0, "account_month": 0, "profit_month": 0}


def test_check_keys_counts_duplicates(spark, tables_small):
    from linelift.sources.schema import Tables
    t = Tables(applications=tables_small.applications,
               accounts=tables_small.accounts.unionByName(tables_small.accounts.limit(3)),
               account_month=tables_small.account_month, profit_month=tables_small.profit_month)
    assert check_keys(t)["accounts"] == 3


def test_status_code_is_the_whole_string(spark, tmp_path):
    """Statuses of several characters and other scripts reach the monthly rows as they are."""
    for name in ("lineitem", "customer"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF_SMALL}/{name}.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    names = {"F": "PX", "O": "\u017dZ", "P": "\u4e2d\u6587"}
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    orders.withColumn("o_orderstatus", mapped[F.col("o_orderstatus")]).write.parquet(
        str(tmp_path / "orders.parquet"))
    t = load_tables(spark, str(tmp_path))
    got = {r[0] for r in t.account_month.select("status_code").distinct().collect()}
    assert got <= set(names.values()) and len(got) > 1
    raw = load_tables(spark, SF_SMALL).account_month.select("account_id", "yr", "mo", "status_code")
    assert {r[0] for r in raw.select("status_code").distinct().collect()} <= set(names)


def test_month_with_profit_is_both_facts(tables_small):
    t = tables_small
    both = t.account_month.join(t.profit_month, ["account_id", "yr", "mo"], "left")
    assert t.month_with_profit.exceptAll(both.select(t.month_with_profit.columns)).isEmpty()
    assert both.count() == t.month_with_profit.count()


def test_no_key_modulus_in_the_package():
    """Rows and values are never left out by a key's remainder."""
    import pathlib
    import re

    import linelift

    for path in pathlib.Path(linelift.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            code = path.read_text()
            assert not re.search(r"(_id|key|acct|nation)\"?\)? *% *[0-9]", code), path
