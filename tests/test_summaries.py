"""Summary operators on tiny inputs with hand-computed results."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from linelift.operators.summaries import (count_by_status, limit_summary, pivot_risk_levels,
                                          roi_by_horizon, share_of_partition, share_of_total)


def test_count_by_status_and_share_of_total(spark):
    df = spark.createDataFrame([("a", "HIT"), ("a", "HIT"), ("a", "NOHIT"), ("b", "HIT"),
                                ("b", None), ("c", "NOHIT")], "k string, bureau_hit string")
    counts = count_by_status(df, "k")
    shares = {r["k"]: tuple(r)[1:] for r in share_of_total(
        counts, ["accounts_hit", "accounts_nohit", "accounts_total"],
        ["s_hit", "s_nohit", "s_total"]).collect()}
    # hit/nohit/total counts, then each over its column total (3, 2, 6)
    assert shares["a"] == (2, 1, 3, 2 / 3, 1 / 2, 3 / 6)
    assert shares["b"] == (1, 0, 2, 1 / 3, 0.0, 2 / 6)
    assert shares["c"] == (0, 1, 1, 0.0, 1 / 2, 1 / 6)


def test_share_of_partition(spark):
    df = spark.createDataFrame([("x", 1, 3), ("x", 2, 1), ("y", 1, 0)], "g string, lvl int, n long")
    out = {(r["g"], r["lvl"]): (r["tot"], r["share"]) for r in
           share_of_partition(df, ["g"], "n", "tot", "share").collect()}
    assert out == {("x", 1): (4, 0.75), ("x", 2): (4, 0.25), ("y", 1): (0, None)}


def test_pivot_risk_levels(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 3), (1, 9), (2, 5)], "m int, risk_level int")
    out = {r["m"]: tuple(r)[1:] for r in pivot_risk_levels(df, F.col("m")).collect()}
    assert out[1] == (4, 2, 0, 0, 1, 0, 0)  # level 9 counts in the total only
    assert out[2] == (1, 0, 0, 0, 0, 0, 1)


def test_limit_summary(spark):
    rows = [("HIT", Decimal("2000.00"), Decimal("4000.00")), ("HIT", Decimal("5000.00"), Decimal("5000.00")),
            ("HIT", None, None)]
    df = spark.createDataFrame(rows, "bureau_hit string, credit_limit decimal(18,2), new_limit decimal(18,2)")
    r = limit_summary(df, "bureau_hit").first()
    assert r["total_accounts"] == 3  # COUNT(*) counts the null-limit row
    assert (r["avg_limit_current"], r["min_limit_current"], r["max_limit_current"]) == (
        3500.0, Decimal("2000.00"), Decimal("5000.00"))
    assert (r["avg_limit_new"], r["min_limit_new"], r["max_limit_new"]) == (
        4500.0, Decimal("4000.00"), Decimal("5000.00"))


def test_roi_by_horizon_counts_distinct_accounts(spark):
    rows = [(1, "k", Decimal("1000.00"), Decimal("100.00"), Decimal("5.00")),
            (1, "k", Decimal("1000.00"), None, Decimal("7.00")),
            (2, "k", Decimal("2000.00"), Decimal("300.00"), None)]
    df = spark.createDataFrame(rows, "account_id long, g string, credit_limit decimal(18,2), "
                                     "placed_6m decimal(18,2), profit_6m decimal(18,2)")
    r = roi_by_horizon(df, ["g"], horizons=(6,)).first()
    assert (r["total_accounts"], r["avg_limit"]) == (2, pytest.approx(4000 / 3, abs=0.005))
    # sums skip nulls on each side separately: 12 / 400
    assert (r["placed_6m"], r["profit_6m"], r["lroi_6m"]) == (Decimal("400.00"), Decimal("12.00"), 0.03)
