"""Property tests: the Column helpers against plain-Python definitions.

Each hypothesis example is a whole list of cases evaluated in one Spark job.
"""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from linelift.functions.bands import BAND_EDGES, BAND_LABELS, limit_band
from linelift.functions.columns import (UNIDENTIFIED_RISK_LABEL, clean_label, floor_zero,
                                        month_diff, safe_divide)

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

dates = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31))
money = st.one_of(st.none(), st.decimals(min_value=-50000, max_value=50000, places=2,
                                         allow_nan=False, allow_infinity=False))


def py_band(limit, income):
    if income is not None and limit is not None and income >= 4000 and limit < 4000:
        return BAND_LABELS[0]
    if limit is None:
        return BAND_LABELS[-1]
    if limit < BAND_EDGES[0]:
        return BAND_LABELS[1]
    for (lo, hi), label in zip(zip(BAND_EDGES, BAND_EDGES[1:]), BAND_LABELS[2:]):
        if lo <= limit < hi:
            return label
    return BAND_LABELS[-2]


@SETTINGS
@given(st.lists(st.tuples(dates, dates), min_size=20, max_size=80))
def test_month_diff_is_calendar_boundaries(spark, pairs):
    df = spark.createDataFrame(pairs, "a date, b date")
    got = [r[0] for r in df.select(month_diff("a", "b")).collect()]
    assert got == [(a.year - b.year) * 12 + a.month - b.month for a, b in pairs]


@SETTINGS
@given(st.lists(st.tuples(money, money), min_size=20, max_size=80))
def test_limit_band_first_match(spark, rows):
    df = spark.createDataFrame(rows, "limit decimal(18,2), income decimal(18,2)")
    got = [r[0] for r in df.select(limit_band("limit", "income")).collect()]
    assert got == [py_band(lim, inc) for lim, inc in rows]


@SETTINGS
@given(st.lists(st.tuples(money, money), min_size=20, max_size=80))
def test_floor_zero_and_safe_divide(spark, rows):
    df = spark.createDataFrame(rows, "x decimal(18,2), y decimal(18,2)")
    got = df.select(floor_zero("x"), safe_divide("x", "y")).collect()
    for (x, y), r in zip(rows, got):
        assert r[0] == (None if x is None else max(x, Decimal("0.00")))
        expected = None if x is None or y is None or y == 0 else float(x) / float(y)
        assert r[1] == expected


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\f\rabcXYZ.0123", max_size=12)),
                min_size=20, max_size=80))
def test_clean_label(spark, labels):
    df = spark.createDataFrame([(v,) for v in labels], "x string")
    got = [r[0] for r in df.select(clean_label("x")).collect()]
    want = [(UNIDENTIFIED_RISK_LABEL if v is None else v).strip(" \t\n\x0b\f\r").upper() for v in labels]
    assert got == want
