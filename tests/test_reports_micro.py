"""Reports on hand-made rows with hand-computed results (FIXTURES.md section 3)."""

from decimal import Decimal

import pytest

from linelift.plans import reports as R
from linelift.plans.params import Params
from linelift.operators import scenario
from fixtures import add_months, app, d, month, tables

P = Params(year_floor=2025, window_from="2025-03-01", window_to="2025-08-31",
           target_from="2025-03-01", target_to="2025-08-31", roi_from="2024-12-01",
           trend_after="2025-01-01", volume_from="2025-01-01", volume_to="2025-12-31")
OPEN = d("2025-01-15")


def mrow(acct, mob, **kw):
    yr, mo = add_months(OPEN, mob)
    return month(acct, yr, mo, **kw)


def r4_tables(spark, segment3="A"):
    spec = {  # account: (status, income, limit, [(mob, balance, level)])
        1: ("HIT", 5000, 2000, [(2, 1000, 2), (3, 1200, 1), (9, 800, 5)]),
        2: ("HIT", 3000, 8000, [(2, 2000, 0), (3, -50, 3)]),
        3: ("NOHIT", 5000, 0, [(2, 100, 2)]),
        4: ("NOHIT", 5000, 1000, [(2, 500, 0)]),
    }
    apps, months, accounts = [], [], []
    for acct, (hit, income, limit, rows) in spec.items():
        seg = segment3 if acct == 3 else "A"
        apps.append(app(acct, hit=hit, income=income, label="alto", segment=seg))
        accounts.append((acct, OPEN))
        months.append(mrow(acct, 1, limit=limit, balance=0, level=0))
        months += [mrow(acct, m, limit=limit, balance=b, level=lv) for m, b, lv in rows]
    return tables(spark, apps, accounts, months)


def by_status(df):
    return {r["bureau_hit"]: r.asDict() for r in df.collect()}


def test_r4_delinquency_what_if(spark):
    out = by_status(R.delinquency_what_if_total(r4_tables(spark), P))
    hit, nohit = out["HIT"], out["NOHIT"]
    assert (hit["applications"], hit["accounts"]) == (2, 2)
    assert hit["dq_rate_2m_actual"] == pytest.approx(1000 / 3000)
    assert hit["dq_rate_2m_new"] == pytest.approx(2000 / 4000)
    assert (hit["dq_rate_3m_actual"], hit["dq_rate_3m_new"]) == (0.0, 0.0)
    assert (hit["dq_rate_9m_actual"], hit["dq_rate_9m_new"]) == (1.0, 1.0)
    assert (nohit["applications"], nohit["accounts"]) == (2, 2)
    assert nohit["dq_rate_2m_actual"] == pytest.approx(100 / 600)
    assert nohit["dq_rate_2m_new"] == 0.0
    assert nohit["dq_rate_3m_actual"] is None and nohit["dq_rate_3m_new"] is None
    assert nohit["dq_rate_9m_actual"] is None and nohit["dq_rate_9m_new"] is None
    assert out["HIT"]["risk_label"] == "ALTO"


def test_r4_peer_branch_projection(spark):
    """Account 3 (limit 0) takes the peer branch: 0.5 x 4000 = 2000."""
    proj = R.scenario_projection(r4_tables(spark), P)
    acct3 = proj.where("account_id = 3").first()
    assert acct3["util_2m"] == pytest.approx(0.5)
    assert acct3["bal_2m_new"] == pytest.approx(2000.0)
    assert acct3["bal_dq_2m_new"] == pytest.approx(0.0)


def test_r8_target_drops_high_limits(spark):
    out = by_status(R.delinquency_what_if_target(r4_tables(spark), P))
    hit = out["HIT"]
    assert (hit["applications"], hit["dq_rate_2m_actual"], hit["dq_rate_2m_new"]) == (1, 1.0, 1.0)
    assert (hit["dq_rate_3m_actual"], hit["dq_rate_3m_new"]) == (0.0, 0.0)
    assert out["NOHIT"]["dq_rate_2m_new"] == 0.0


def test_s8_null_peer_key_gets_no_benchmark(spark):
    t = r4_tables(spark, segment3=None)
    lines = R.scenario_lines(t, P)
    literal = scenario.scenario_totals(R.scenario_projection(t, P))
    grouped = scenario.grouped_scenario_totals(lines)
    for df in (literal, grouped):
        nohit = by_status(df)["NOHIT"]
        assert nohit["total_bal_2m_new"] == pytest.approx(2000.0)  # account 4 only
        assert nohit["total_bal_2m"] == Decimal("600.00")


def test_grouped_totals_equal_row_level_totals(spark, tables_small):
    from linelift.plans.params import DEFAULT
    for target in (False, True):
        lines = R.scenario_lines(tables_small, DEFAULT, target=target)
        a = {(r["bureau_hit"], r["risk_label"]): r.asDict() for r in
             scenario.scenario_totals(R.scenario_projection(tables_small, DEFAULT, target=target)).collect()}
        b = {(r["bureau_hit"], r["risk_label"]): r.asDict() for r in
             scenario.grouped_scenario_totals(lines).collect()}
        assert a.keys() == b.keys() and a
        for k in a:
            for c, v in a[k].items():
                if isinstance(v, float):
                    assert b[k][c] == pytest.approx(v, rel=1e-12), (k, c)
                else:
                    assert b[k][c] == v, (k, c)


def test_r1_lroi_asymmetric_sums(spark):
    open_ = d("2024-12-10")

    def row(acct, mob, **kw):
        yr, mo = add_months(open_, mob)
        return month(acct, yr, mo, **kw)

    t = tables(
        spark,
        applications=[app(1, date="2024-12-10", label="alto"), app(2, date="2024-12-11", label="alto")],
        accounts=[(1, open_), (2, open_)],
        account_month=[row(1, 1, limit=2000), row(1, 6, limit=2000, purchases=5000, returns=1000),
                       row(2, 1, limit=3000), row(2, 9, limit=3000, purchases=6000, returns=0)],
        profit_month=[(1, *add_months(open_, 6), 200), (1, *add_months(open_, 9), 300)],
    )
    out = R.lroi_by_cohort(t, P.with_(year_floor=2024)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["open_period"], r["bureau_hit"], r["risk_label"]) == ("2024-12", "HIT", "ALTO")
    assert (r["total_accounts"], r["avg_limit"]) == (2, 2500.0)
    assert (r["placed_6m"], r["profit_6m"], r["lroi_6m"]) == (Decimal("4000.00"), Decimal("200.00"), 0.05)
    assert (r["placed_9m"], r["profit_9m"], r["lroi_9m"]) == (Decimal("6000.00"), Decimal("300.00"), 0.05)
    assert (r["placed_12m"], r["profit_12m"], r["lroi_12m"]) == (None, None, None)


def test_r6_pivot_zero_fills_and_counts_unlisted_levels(spark):
    apps = [app(i + 1, date="2025-02-03", hit="NOHIT", level=lv) for i, lv in enumerate([0, 0, 5, 6, None])]
    apps.append(app(9, date="2025-02-04", hit="HIT", level=1))
    out = R.application_volume_pivot(tables(spark, apps), P).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["cohort_month"], r["total_applications"]) == (d("2025-02-01"), 4)
    assert [r[f"applications_r{v}"] for v in range(6)] == [2, 0, 0, 0, 0, 1]


def _banded_tables(spark, rows):
    """rows: (account, status, level, limit); every account in its own month fact."""
    apps = [app(a, hit=h, level=lv, income=100) for a, h, lv, _ in rows]
    months = [mrow(a, 1, limit=lim) for a, _, _, lim in rows]
    return tables(spark, apps, [(a, OPEN) for a, *_ in rows], months)


def test_r7_risk_mix_shares(spark):
    rows = [(1, "NOHIT", 1, 5000), (2, "NOHIT", 1, 5000), (3, "NOHIT", 1, 5000),
            (4, "NOHIT", 2, 5000), (5, "NOHIT", None, 5000), (6, "HIT", 1, 5000)]
    out = [tuple(r) for r in R.risk_mix_by_band(_banded_tables(spark, rows), P).collect()]
    assert out == [("c. [4000, 6000)", 1, 3, 4, 0.75), ("c. [4000, 6000)", 2, 1, 4, 0.25)]


def test_r2_shares_per_column(spark):
    rows = [(1, "HIT", 1, 5000), (2, "HIT", 1, 5000), (3, "HIT", 1, 5000), (4, "HIT", 1, 7000),
            (5, "NOHIT", 1, 7000)]
    out = {r["limit_band"][0]: tuple(r)[1:] for r in
           R.limit_band_distribution(_banded_tables(spark, rows), P).collect()}
    assert out["c"] == (3, 0, 3, 0.75, 0.0, 0.6)
    assert out["d"] == (1, 1, 2, 0.25, 1.0, 0.4)
    only_hit = R.limit_band_distribution(_banded_tables(spark, rows[:4]), P).collect()
    assert all(r["share_nohit"] is None for r in only_hit)


def test_r9_activation_and_band_counts_match_r2(spark, tables_small):
    from linelift.plans.params import DEFAULT
    r2 = {r["limit_band"]: (r["accounts_hit"], r["accounts_nohit"])
          for r in R.limit_band_distribution(tables_small, DEFAULT).collect()}
    r9 = {r["limit_band"]: (r["accounts_hit"], r["accounts_nohit"])
          for r in R.activation_by_band(tables_small, DEFAULT).collect()}
    assert r2 == r9 and r2  # S12: the two reports count the same accounts per band


def test_s16_year_floor_after_window_falls_back_to_max(spark):
    """Balances read from a later year than the opening month: no MOB <= 1 row,
    so the origination limit is the largest limit seen."""
    t = tables(spark, [app(1, income=100)], [(1, OPEN)],
               [mrow(1, 1, limit=1000), mrow(1, 13, limit=9000), mrow(1, 14, limit=7000)])
    out = R.limit_what_if_summary(t, P.with_(year_floor=2026)).first()
    assert out["max_limit_current"] == Decimal("9000.00")
    out = R.limit_what_if_summary(t, P).first()
    assert out["max_limit_current"] == Decimal("1000.00")
