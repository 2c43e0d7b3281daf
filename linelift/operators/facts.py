"""Row-level building blocks: eligibility filters, months on book, universes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelift.functions.columns import clean_label, month_diff, month_start, month_trunc

# Account statuses that mark a closed account, and the bureau
# statuses the reports work with.
CLOSED_STATUSES = ("T", "P", "Z", "8", "9")
HIT_NOHIT = ("HIT", "NOHIT")
ALL_BUREAU = ("HIT", "THIN FILE", "NOHIT")


def _date(d: str | dt.date) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def eligible_applications(applications: DataFrame, *, org_code: int,
                          date_from: str | dt.date | None = None,
                          date_to: str | dt.date | None = None,
                          from_strict: bool = False,
                          bureau_in: Sequence[str] | None = None,
                          risk_level_known: bool = False) -> DataFrame:
    """Product, application-date window and valid account.

    ``date_from`` is inclusive unless ``from_strict``; ``date_to`` is inclusive.
    Every predicate is a plain comparison, so all of them reach the Parquet scan.
    """
    cond = (F.col("org_code") == org_code) & (F.col("account_id") > 0)
    if date_from is not None:
        d = F.col("application_date")
        cond &= (d > _date(date_from)) if from_strict else (d >= _date(date_from))
    if date_to is not None:
        cond &= F.col("application_date") <= _date(date_to)
    if bureau_in is not None:
        cond &= F.col("bureau_hit").isin(*bureau_in)
    if risk_level_known:
        cond &= F.col("risk_level").isNotNull()
    return applications.where(cond)


def open_account_months(account_month: DataFrame, *, info_type: int, year_floor: int,
                        excluded_statuses: Sequence[str] = CLOSED_STATUSES) -> DataFrame:
    """Monthly rows of the product, not closed, from ``year_floor`` on (``is_open``).

    ``NOT IN`` drops null statuses as well (the predicate is null for them).
    ``yr`` is the partition column of a materialised fact, so the floor prunes files.
    """
    return account_month.where(is_open(info_type, excluded_statuses)
                               & (F.col("yr") >= year_floor))


def is_open(info_type: int, excluded_statuses: Sequence[str] = CLOSED_STATUSES) -> Column:
    """Whether a monthly row is of the product and not closed (null for a null status)."""
    return (F.col("info_type") == info_type) & ~F.col("status_code").isin(*excluded_statuses)


def accounts_repeat(accounts: DataFrame) -> bool:
    """Whether an account has several rows: one distributed aggregation, one row to the driver."""
    rows = accounts.where(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"))
    return not rows.where(F.col("n") > 1).isEmpty()


def unique_accounts(accounts: DataFrame) -> DataFrame:
    """``accounts``, failing when an account has several rows.

    Where the accounts are known to be unique, the reports carry per-account aggregates along
    instead of joining them back as often as the source does. This guards the
    knowledge as part of the plan: its aggregate is partitioned like the join above it.
    """
    several = F.raise_error(F.concat(F.lit("accounts has several rows for account_id "),
                                     F.col("account_id").cast("string")))
    return (accounts.where(F.col("account_id").isNotNull()).groupBy("account_id")
            .agg(F.count(F.lit(1)).alias("_rows"), F.max("open_date").alias("open_date"))
            .select("account_id", F.when(F.col("_rows") == 1, F.col("open_date"))
                    .otherwise(several).alias("open_date")))


def months_on_book(months: DataFrame, accounts: DataFrame, how: str = "left",
                   unique: bool = True) -> DataFrame:
    """Add ``open_date`` and ``mob`` (calendar months from the opening month).

    ``how="left"`` keeps month rows without an account row (``open_date`` and
    ``mob`` null); ``how="inner"`` drops them. With ``unique``, an account with
    several rows fails the plan (``unique_accounts``); without, each month meets
    every row of its account, as in the source.
    """
    accounts = (unique_accounts(accounts) if unique else
                accounts.where(F.col("account_id").isNotNull()).select("account_id", "open_date"))
    joined = months.join(accounts, "account_id", how)
    return joined.withColumn("mob", month_diff(month_start("yr", "mo"), month_trunc("open_date")))


def net_placement(purchases: str = "purchases_ltd", returns: str = "returns_ltd") -> Column:
    """Life-to-date purchases minus returns."""
    return F.col(purchases) - F.col(returns)


def latest_applications(applications: DataFrame) -> DataFrame:
    """One application per account: the latest, ties broken by the other columns."""
    rest = [c for c in applications.columns if c not in ("account_id", "application_date")]
    latest = F.max(F.struct("application_date", *rest)).alias("latest")
    return applications.groupBy("account_id").agg(latest).select("account_id", "latest.*").select(
        *applications.columns)


def distinct_universe(applications: DataFrame, *, org_code: int, date_from: str | dt.date,
                      bureau_in: Sequence[str] | None = None) -> DataFrame:
    """De-duplicated (account, bureau status, clean label, income) from a date on."""
    apps = eligible_applications(applications, org_code=org_code, date_from=date_from,
                                 bureau_in=bureau_in)
    return apps.select(
        "account_id", "bureau_hit", clean_label("risk_label").alias("risk_label"), "income",
    ).distinct()
