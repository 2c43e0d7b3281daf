"""Reports under non-default parameters against the oracle built from the same
parameters (sf0.001): the other extraction status (FLT15), R8 reading
balances from a later year than its applications (S16), other windows and
thresholds."""

import dataclasses

import pytest

from linelift.oracle import oracle_sql
from linelift.plans.params import DEFAULT
from linelift.plans.reports import REPORTS
from linelift.sources.tpch import load_tables
from fixtures import SF_SMALL
from oracle_compare import compare, duck_connect



def changed(p):
    """The parameters that differ from the defaults."""
    return {f.name: getattr(p, f.name) for f in dataclasses.fields(p)
            if getattr(p, f.name) != getattr(DEFAULT, f.name)}


VARIANTS = {
    "hit_extract": DEFAULT.with_(extract_status="HIT"),
    "r8_later_balances": DEFAULT.with_(target_from="1995-01-01", target_to="1995-06-30",
                                       target_year_floor=1996),
    "shifted_windows": DEFAULT.with_(window_from="1996-01-01", window_to="1996-09-30",
                                     roi_from="1996-03-01", trend_after="1996-01-31",
                                     volume_from="1996-01-01", volume_to="1998-12-31",
                                     year_floor=1996),
    "earlier_roi_floor": DEFAULT.with_(year_floor=1996, roi_year_floor=1995),
    "thin_file_extract": DEFAULT.with_(extract_status="THIN FILE"),
    "latest_application": DEFAULT.with_(dedupe_applications=True, window_to="1996-12-31"),
    "other_tables": DEFAULT.with_(
        band_edges=(1000, 5000, 9000), band_labels=("a", "b", "c", "d", "e", "f"),
        delinquency_levels=((2, 1), (3, 4), (6, 2), (9, 6), (12, 3)), horizons=(3, 4),
        risk_levels=(1, 6)),
    "other_thresholds": DEFAULT.with_(target_limit=6000, min_income=2500, activation_months=1),
}


@pytest.fixture(scope="module")
def duck():
    con = duck_connect(SF_SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("variant", sorted(VARIANTS))
def test_reports_match_oracle_under_params(spark, duck, variant):
    p = VARIANTS[variant]
    sql = oracle_sql(**changed(p))
    t = load_tables(spark, SF_SMALL)
    failures = {}
    for name, fn in REPORTS.items():
        problems = compare(fn(t, p), duck, sql[name])
        if problems:
            failures[name] = problems[:2]
    assert not failures, failures
