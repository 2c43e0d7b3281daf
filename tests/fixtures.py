"""Build the four portfolio tables from a few hand-written rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from linelift.sources.schema import SCHEMAS, Tables

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def money(v):
    return None if v is None else Decimal(str(v)).quantize(Decimal("0.01"))


def add_months(day: dt.date, k: int) -> tuple[int, int]:
    idx = day.year * 12 + (day.month - 1) + k
    return idx // 12, idx % 12 + 1


def app(account_id, *, date="2025-03-10", org=210, hit="HIT", income=5000, level=1,
        label="3. alto", segment="A"):
    return (account_id, d(date), org, hit, money(income), level, label, segment)


def month(account_id, yr, mo, *, limit=None, balance=0, level=0, status="A", info=210,
          first_purchase=None, purchases=0, returns=0):
    return (account_id, yr, mo, info, status, level, money(balance), money(limit),
            None if first_purchase is None else d(first_purchase), money(purchases),
            money(returns))


def tables(spark, applications=(), accounts=(), account_month=(), profit_month=()) -> Tables:
    def df(name, rows):
        return spark.createDataFrame(list(rows), SCHEMAS[name])

    return Tables(
        applications=df("applications", applications),
        accounts=df("accounts", [(a, d(o) if isinstance(o, str) else o) for a, o in accounts]),
        account_month=df("account_month", account_month),
        profit_month=df("profit_month", [(a, y, m, money(p)) for a, y, m, p in profit_month]),
    )
