"""Per-account aggregates over the monthly fact (one row per account).

This is the only wide step over the large fact. Each helper returns aggregate
expressions, so a report asks for exactly the columns it needs in a single
``groupBy().agg()`` (partial aggregation on the map side, one shuffle on the
account key) and Catalyst drops whatever a report leaves unused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelift.functions.columns import col_, floor_zero, month_diff
from linelift.operators.bloom import may_contain

# Milestone month on book -> minimum delinquency level that
# counts as delinquent there (entry at 2, 30+ at 3 and 6, 90+ at 9 and 12).
DELINQUENCY_MILESTONES = {2: 2, 3: 3, 6: 3, 9: 5, 12: 5}
VALUE_MILESTONES = (6, 9, 12)
ACTIVATION_MONTHS = 3


def origination_limit(mob: Column | str = "mob", limit: Column | str = "credit_limit") -> Column:
    """The largest limit seen at MOB <= 1, else the largest limit ever seen."""
    mob, limit = col_(mob), col_(limit)
    return F.coalesce(F.max(F.when(mob <= 1, limit)), F.max(limit))


def milestone_values(value: Column | str, months: Sequence[int] = VALUE_MILESTONES,
                     prefix: str = "value", mob: Column | str = "mob") -> list[Column]:
    """The value at each milestone MOB; null when that month is absent."""
    mob, value = col_(mob), col_(value)
    return [F.max(F.when(mob == m, value)).alias(f"{prefix}_{m}m") for m in months]


def milestone_delinquency(milestones: Mapping[int, int] = DELINQUENCY_MILESTONES,
                          mob: Column | str = "mob", level: Column | str = "delinquency_level",
                          balance: Column | str = "balance") -> list[Column]:
    """Four columns per milestone, 0 when the month is absent.

    ``accts_{m}m`` presence flag, ``bal_{m}m`` balance floored at 0,
    ``accts_dq_{m}m`` delinquent flag, ``bal_dq_{m}m`` delinquent balance.
    A null balance floors to null and ``max`` skips it, so the balance is 0 if
    the account has other rows and null only if that was its single row.
    """
    mob, level = col_(mob), col_(level)
    bal = floor_zero(balance)
    out = []
    for m, threshold in milestones.items():
        at = mob == m
        dq = at & (level >= threshold)
        out += [
            F.max(F.when(at, 1).otherwise(0)).alias(f"accts_{m}m"),
            F.max(F.when(at, bal).otherwise(0)).alias(f"bal_{m}m"),
            F.max(F.when(dq, 1).otherwise(0)).alias(f"accts_dq_{m}m"),
            F.max(F.when(dq, bal).otherwise(0)).alias(f"bal_dq_{m}m"),
        ]
    return out


def delinquency_columns(milestones: Mapping[int, int] = DELINQUENCY_MILESTONES) -> list[str]:
    """Names of the columns ``milestone_delinquency`` produces, in order."""
    return [f"{k}_{m}m" for m in milestones for k in ("accts", "bal", "accts_dq", "bal_dq")]


def activation_flag(first_purchase: Column | str = "first_purchase_date",
                    open_date: Column | str = "open_date",
                    months: int = ACTIVATION_MONTHS) -> Column:
    """1 if any row has a first purchase within +-``months`` calendar months
    of the opening date (raw dates, absolute value), else 0."""
    fp, od = col_(first_purchase), col_(open_date)
    hit = fp.isNotNull() & (F.abs(month_diff(fp, od)) <= months)
    return F.max(F.when(hit, 1).otherwise(0))


def restrict(fact: DataFrame, universe: DataFrame | None, key: str = "account_id",
             prefilter: bool = False) -> DataFrame:
    """Keep only fact rows whose key occurs in ``universe`` (left-semi join).

    Used below an aggregate keyed by ``key`` whose result is later inner-joined
    on ``key`` with that universe, so the result is unchanged while the
    aggregate reads only the accounts that can survive the join. AQE turns it
    into a broadcast semi join when the universe is measured small.

    The key set is de-duplicated first: an account with a huge number of
    applications collapses to one row in the partial aggregate of each map
    task instead of landing on one semi-join task, and the de-duplication's
    exchange is the hash partitioning the semi join needs anyway.

    ``prefilter``: drop most foreign rows in the fact's scan stage by a bounded Bloom filter
    over the keys (``operators.bloom``). It pays where the key set is too large to be broadcast
    and the fact must be shuffled; the semi join behind it decides.
    """
    if universe is None:
        return fact
    if prefilter:
        fact = fact.where(may_contain(universe, key))
    return fact.join(universe.select(key).distinct(), key, "left_semi")


def account_profile(mob_fact: DataFrame, keys: Sequence[str] = ("account_id", "open_date"),
                    *aggs: Column) -> DataFrame:
    """One row per ``keys`` with the origination limit plus ``aggs``."""
    return mob_fact.groupBy(*keys).agg(origination_limit().alias("credit_limit"), *aggs)


def account_pairs(profile: DataFrame) -> DataFrame:
    """The source's join of per-account rows with those of the same account: one row per pair.

    A profile has a row per account and opening date. The source takes an application's limit
    from one of them (``credit_limit``) and joins the account's rows back once more
    for the balances to project (their limit is ``peer_limit``; all other columns are theirs). The
    pairs are made inside one row per account, which holds its few opening dates, so the profile is
    aggregated once and nothing is shuffled again.
    """
    rows = profile.withColumnRenamed("credit_limit", "peer_limit")
    others = [c for c in rows.columns if c != "account_id"]
    return (rows.groupBy("account_id").agg(F.collect_list(F.struct(*others)).alias("rows"))
            .select("account_id", F.explode("rows.peer_limit").alias("credit_limit"), "rows")
            .select("account_id", "credit_limit", F.inline("rows")))


def profit_milestones(profit_month: DataFrame, accounts: DataFrame, universe: DataFrame, *,
                      year_floor: int, months: Sequence[int] = VALUE_MILESTONES,
                      unique: bool = True, prefilter: bool = False) -> DataFrame:
    """Cumulative profit at each milestone MOB for accounts in ``universe``.

    A max is the same however often a row is repeated, so the universe (several
    rows per account) only restricts, by a semi join.
    """
    from linelift.operators.facts import months_on_book

    rows = restrict(profit_month.where(F.col("yr") >= year_floor), universe, prefilter=prefilter)
    rows = months_on_book(rows, accounts, "inner", unique).where(F.col("mob").isin(*months))
    return rows.groupBy("account_id").agg(*milestone_values("profit_ltd", months, "profit"))
