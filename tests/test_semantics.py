"""Rules that the test tables do not reach: Unicode white space, the printed status, unique
accounts, a floor of its own for R1, exact sums."""

import pytest
from pyspark.sql import functions as F

from fixtures import app, month, tables
from linelift.functions.columns import (UNIDENTIFIED_RISK_LABEL, clean_label, fixed_mean,
                                        fixed_sum)
from linelift.oracle import WHITE_SPACE, oracle_sql
from linelift.plans import reports as R
from linelift.plans.batch import run_reports
from linelift.plans.params import DEFAULT, Params
from linelift.sources.schema import Tables


@pytest.mark.parametrize("point", WHITE_SPACE)
def test_labels_lose_all_unicode_white_space(spark, point):
    c = chr(point)
    df = spark.createDataFrame([(f"{c}{c}3. alto{c} x{c}\n",), (f"{c}0. no identificado{c}",)], "l string")
    got = [r[0] for r in df.select(clean_label("l")).collect()]
    assert got == [f"3. ALTO{c} X", UNIDENTIFIED_RISK_LABEL]


def test_other_marks_stay(spark):
    df = spark.createDataFrame([("​ a﻿",)], "l string")
    assert df.select(clean_label("l")).first()[0] == "​ A﻿"


def _one_account(spark, **kw):
    months = [month(1, 2024 + (m - 1) // 12, (m - 1) % 12 + 1, limit=1000, balance=100, purchases=10 * m)
              for m in range(1, 25)]
    return tables(spark, kw.get("applications", [app(1)]), [(1, "2024-06-15")], months,
                  [(1, 2024, 12, 5), (1, 2025, 3, 9)])


P25 = DEFAULT.with_(year_floor=2025, roi_year_floor=2024, window_from="2025-01-01", window_to="2025-12-31",
                    roi_from="2025-01-01", trend_after="2025-01-01", volume_from="2025-01-01",
                    volume_to="2025-12-31", target_from="2024-11-01", target_to="2025-12-31")


def test_r1_reads_a_year_more(spark):
    t = _one_account(spark)
    row = R.lroi_by_cohort(t, P25).collect()[0]
    assert (row["placed_6m"], row["profit_6m"], row["placed_9m"], row["profit_9m"]) == (120, 5, 150, 9)
    late = R.lroi_by_cohort(t, P25.with_(roi_year_floor=2025)).collect()[0]
    assert (late["placed_6m"], late["profit_6m"], late["placed_9m"]) == (None, None, 150)
    shared = run_reports(t, P25)["lroi_by_cohort"].collect()
    assert shared == R.lroi_by_cohort(t, P25).collect()


def test_combined_months_give_the_same_r1(spark, tables_small):
    """With and without a source that offers both monthly facts on one row."""
    plain = Tables(**tables_small.as_dict())
    for p in (DEFAULT, DEFAULT.with_(year_floor=1997, roi_year_floor=1996)):
        assert R.lroi_by_cohort(plain, p).collect() == R.lroi_by_cohort(tables_small, p).collect()


@pytest.mark.parametrize("status", ["THIN FILE", "OTHER"])
def test_only_the_two_statuses_are_extracted(spark, tables_small, status):
    p = DEFAULT.with_(extract_status=status)
    assert R.application_volume_pivot(tables_small, p).count() == 0
    assert R.risk_mix_by_band(tables_small, p).count() == 0


@pytest.fixture(scope="module")
def reopened(spark, tables_small):
    """Accounts with one to three rows, some of them equal, and the same relations in DuckDB."""
    import duckdb

    accounts = tables_small.accounts
    accounts = (accounts.unionByName(accounts.where("account_id % 3 = 0"))
                .unionByName(accounts.where("account_id % 2 = 0")
                             .withColumn("open_date", F.add_months("open_date", 5)))
                .unionByName(accounts.where("account_id % 4 = 0")
                             .withColumn("open_date", F.add_months("open_date", -1)))).cache()
    t = Tables(tables_small.applications, accounts, tables_small.account_month, tables_small.profit_month)
    con = duckdb.connect()
    for name, df in t.as_dict().items():
        con.register(f"{name}_rows", df.toArrow())
        con.execute(f"create table {name} as select * from {name}_rows")
    yield t, con
    con.close()


@pytest.mark.parametrize("name", list(R.REPORTS))
def test_repeated_accounts_as_in_the_source(reopened, name):
    """An application meets each of its account's openings; R4 and R8 join the balances of each
    back to the limit of each."""
    from oracle_compare import compare

    t, con = reopened
    assert t.accounts_unique is False
    sql = oracle_sql(surrogates=False)[name]
    assert compare(R.REPORTS[name](t, DEFAULT), con, sql) == []
    with run_reports(t, DEFAULT, [name]) as batch:
        assert compare(batch[name], con, sql) == []


def test_repeated_accounts_stored(spark, reopened, tmp_path):
    from linelift.sources.warehouse import read_tables, write_tables
    from oracle_compare import compare

    t, con = reopened
    write_tables(t, str(tmp_path / "t"))
    stored = read_tables(spark, str(tmp_path / "t"))
    assert stored.accounts_unique is False
    for name in ("delinquency_what_if_total", "limit_band_distribution"):
        assert compare(R.REPORTS[name](stored, DEFAULT), con, oracle_sql(surrogates=False)[name]) == []


@pytest.mark.parametrize("name", ["delinquency_what_if_total", "limit_band_distribution"])
def test_queries_over_openings_read_given_tables(spark, reopened, tmp_path, name):
    """Tables in memory or stored hold their openings already; the query reads them as they are."""
    from linelift.plans.catalog import QUERIES
    from linelift.sources.warehouse import read_tables, write_tables
    from oracle_compare import compare

    t, con = reopened
    sql = oracle_sql(surrogates=False)[f"{name}_reopened"]
    write_tables(t, str(tmp_path / "t"))
    for source in (t, read_tables(spark, str(tmp_path / "t"))):
        assert compare(QUERIES[f"{name}_reopened"](source, DEFAULT), con, sql) == []


def test_row_level_scenario_agrees_with_repeated_accounts(reopened):
    from linelift.operators import scenario

    t, _ = reopened
    for target in (False, True):
        rows = R.scenario_projection(t, DEFAULT, target=target,
                                     statuses=("HIT", "NOHIT") if target else ("HIT", "THIN FILE", "NOHIT"))
        total = scenario.delinquency_ratios(scenario.scenario_totals(rows)).orderBy("bureau_hit", "risk_label")
        report = R.delinquency_what_if_target if target else R.delinquency_what_if_total
        assert total.collect() == report(t, DEFAULT).collect()


@pytest.mark.parametrize("name", [n for n in R.REPORTS if n != "application_volume_pivot"])
def test_a_source_that_wrongly_claims_unique_accounts_is_refused(reopened, name):
    t, _ = reopened

    class Claims(Tables):
        accounts_unique = True

    with pytest.raises(Exception, match="several rows for account_id"):
        R.REPORTS[name](Claims(**t.as_dict()), DEFAULT).collect()


def test_exact_sums_do_not_depend_on_the_order(spark):
    values = [(0.1 * k if k % 7 else None,) for k in range(1000)]
    sums = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(values, "x double").repartition(parts)
        sums.add(tuple(df.agg(fixed_sum("x"), fixed_mean("x")).first()))
    assert len(sums) == 1
    total = sum(v for v, in values if v is not None)
    assert sums.pop() == pytest.approx((total, total / sum(v is not None for v, in values)))
    weighted = spark.createDataFrame([(0.5, 3), (0.25, 1), (None, 9)], "x double, w long")
    assert tuple(weighted.agg(fixed_sum("x", weight=F.col("w")), fixed_mean("x", weight=F.col("w"))).first()) == (
        1.75, 0.4375)


def test_oracle_has_its_own_constants():
    """A library constant that is changed must not reach the oracle."""
    import ast
    import pathlib

    import linelift.oracle

    tree = ast.parse(pathlib.Path(linelift.oracle.__file__).read_text())
    imported = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    assert [n.module for n in imported] == ["__future__"]
    assert Params().with_(**linelift.oracle.DEFAULTS) == DEFAULT


@pytest.mark.parametrize("change", [
    {"band_labels": ("x.", *DEFAULT.band_labels[1:])},
    *[{"delinquency_levels": tuple((m, lv + (m == month)) for m, lv in DEFAULT.delinquency_levels)}
      for month in (2, 3, 6, 9, 12)]])
def test_a_wrong_constant_shows(spark, tables_small, change):
    from fixtures import SF_SMALL
    from linelift.plans.catalog import QUERIES
    from oracle_compare import compare, duck_connect

    sql, wrong = oracle_sql(), DEFAULT.with_(**change)
    key = "limit_band_distribution" if "band_labels" in change else "milestone_delinquency"
    assert compare(QUERIES[key](tables_small, wrong), duck_connect(SF_SMALL), sql[key])
