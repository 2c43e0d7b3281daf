"""The four input relations of the portfolio model and their Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

APPLICATIONS = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("application_date", T.DateType()),
    T.StructField("org_code", T.IntegerType()),
    T.StructField("bureau_hit", T.StringType()),
    T.StructField("income", MONEY),
    T.StructField("risk_level", T.IntegerType()),
    T.StructField("risk_label", T.StringType()),
    T.StructField("score_segment", T.StringType()),
])

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("open_date", T.DateType()),
])

ACCOUNT_MONTH = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("yr", T.IntegerType()),
    T.StructField("mo", T.IntegerType()),
    T.StructField("info_type", T.IntegerType()),
    T.StructField("status_code", T.StringType()),
    T.StructField("delinquency_level", T.IntegerType()),
    T.StructField("balance", MONEY),
    T.StructField("credit_limit", MONEY),
    T.StructField("first_purchase_date", T.DateType()),
    T.StructField("purchases_ltd", MONEY),
    T.StructField("returns_ltd", MONEY),
])

PROFIT_MONTH = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("yr", T.IntegerType()),
    T.StructField("mo", T.IntegerType()),
    T.StructField("profit_ltd", MONEY),
])

SCHEMAS = {
    "applications": APPLICATIONS,
    "accounts": ACCOUNTS,
    "account_month": ACCOUNT_MONTH,
    "profit_month": PROFIT_MONTH,
}


class TableSource(Protocol):
    """What the reports read: the four relations, however they are provided
    (``Tables`` in memory, ``sources.tpch.DerivedTables``,
    ``sources.warehouse.StoredTables``)."""

    @property
    def applications(self) -> DataFrame: ...

    @property
    def accounts(self) -> DataFrame: ...

    @property
    def account_month(self) -> DataFrame: ...

    @property
    def profit_month(self) -> DataFrame: ...

    @property
    def accounts_unique(self) -> bool:
        """Whether no account has several rows in ``accounts``."""
        ...

    @property
    def reopened(self) -> "TableSource":
        """The tables with a row per opening of an account: themselves, unless the source
        derives ``accounts`` and can choose."""
        ...

    def as_dict(self) -> dict[str, DataFrame]: ...


@dataclass(frozen=True)
class Tables:
    """The model's inputs. ``account_month`` and ``profit_month`` are keyed by
    (account_id, yr, mo); ``accounts`` is keyed by account_id, or by account_id and
    open_date (an account that was opened several times)."""

    applications: DataFrame
    accounts: DataFrame
    account_month: DataFrame
    profit_month: DataFrame

    @cached_property
    def accounts_unique(self) -> bool:
        """Looked up in the table when it is first asked for."""
        from linelift.operators.facts import accounts_repeat

        return not accounts_repeat(self.accounts)

    @property
    def reopened(self) -> "Tables":
        """These tables; ``accounts`` holds the openings that it was given."""
        return self

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def conform(df: DataFrame, schema: T.StructType, name: str = "") -> DataFrame:
    """Select the schema's columns in order and check their types (no action)."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    out = df.select(*[f.name for f in schema.fields])
    actual = {f.name: f.dataType for f in out.schema.fields}
    wrong = {f.name: (actual[f.name].simpleString(), f.dataType.simpleString())
             for f in schema.fields if actual[f.name] != f.dataType}
    if wrong:
        raise TypeError(f"{name}: column types differ from the model (actual, expected): {wrong}")
    return out


KEYS = {
    "accounts": ("account_id",),
    "account_month": ("account_id", "yr", "mo"),
    "profit_month": ("account_id", "yr", "mo"),
}


def check_keys(tables: TableSource) -> dict[str, int]:
    """Number of duplicated keys per keyed table (0 everywhere = the model holds).

    The reports carry per-account aggregates instead of joining them back, and
    the batch mode shares one profile; both rely on these keys. One
    distributed aggregation per table; only the counts reach the driver.
    """
    out = {}
    for name, key in KEYS.items():
        dup = (getattr(tables, name).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
               .first()[0])
        out[name] = int(dup)
    return out
