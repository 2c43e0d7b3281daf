"""Portfolio tables derived in Spark from the TPC-H-style test tables.

Mapping (FIXTURES.md section 2): an account is a customer, an application is
an order, and a monthly snapshot row is a customer x ship month of its line
items. Both monthly facts come from one customer-month aggregate of
``lineitem`` joined to ``orders``; ``month_with_profit`` offers both on one row,
so a plan that needs both (``lroi_by_cohort``) scans ``lineitem`` once.

Every gap comes from the data: an account opens with its first completed
order, so a customer without one has no ``accounts`` row (left-join misses);
profit is booked for completed lines only, so a month without any has no profit
row; a balance is null in a month whose lines are all untaxed, a limit in a
month whose lines are all undiscounted.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelift.sources.schema import MONEY, SCHEMAS, TableSource, conform

# The product code every surrogate row carries.
PRODUCT_CODE = 210
OTHER_PRODUCT_CODE = 110


# The columns of the test tables this mapping reads. Reading with a declared
# schema skips Spark's schema-inference job (one per read) and fails fast on a
# type change.
RAW_SCHEMAS = {
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
}


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three test tables the mapping needs, each read once."""
    return {name: spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
            for name, schema in RAW_SCHEMAS.items()}


def customer_month(raw: dict[str, DataFrame], year_floor: int | None = None) -> DataFrame:
    """One row per (customer, ship year, ship month) with every monthly measure.

    ``year_floor``: only months from that year on, as a range of ship dates that reaches the scan
    of ``lineitem`` and skips its row groups.

    A month's status is its smallest. The minimum of a string would make the aggregate over the
    largest relation sort its rows, so it is taken over the statuses' places in their sorted
    list, which the plan reads from ``orders`` itself.
    """
    lineitem, orders = raw["lineitem"], raw["orders"]
    if year_floor is not None:
        start = F.to_timestamp_ntz(F.lit(f"{year_floor:04d}-01-01 00:00:00"))
        lineitem = lineitem.where(F.col("l_shipdate") >= start)
    statuses = orders.agg(F.array_sort(F.collect_set("o_orderstatus"))).scalar()
    ship = F.col("l_shipdate").cast("date")
    qty = F.col("l_quantity").cast("int")
    returned = F.col("l_returnflag") == "R"
    # Money is summed as exact cents in a long: the same values as a decimal
    # sum, without the BigDecimal buffers a DECIMAL(28+) sum uses.
    cents = (F.col("l_extendedprice").cast(MONEY) * 100).cast("long")
    completed = F.col("l_linestatus") == "F"
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey, "inner")
        .groupBy(F.col("o_custkey").alias("account_id"),
                 F.year(ship).cast("int").alias("yr"),
                 F.month(ship).cast("int").alias("mo"))
        .agg(
            F.min(F.array_position(statuses, F.col("o_orderstatus"))).alias("status_place"),
            F.max("l_linenumber").alias("delinquency_level"),
            F.sum(F.when(returned, -100).otherwise(100) * qty).alias("net_units"),
            F.min("l_extendedprice").alias("min_price"),
            F.max("l_tax").alias("max_tax"),
            F.max("l_discount").alias("max_discount"),
            F.min(F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 40), ship))
            .alias("first_purchase_date"),
            F.sum(cents).alias("purchase_cents"),
            F.sum(F.when(returned, cents).otherwise(0)).alias("return_cents"),
            F.sum(F.when(completed, F.when(returned, -50).otherwise(80) * qty))
            .alias("profit_units"),
        )
        .withColumn("status_code", F.get(statuses, (F.col("status_place") - 1).cast("int")))
        .drop("status_place")
    )


def _life_to_date(col: str, scale: int = 0) -> F.Column:
    """Running sum per account in (yr, mo) order, as DECIMAL(18,2); ``scale``
    is the number of decimals ``col`` carries as an integer (2 for cents)."""
    w = (Window.partitionBy("account_id").orderBy("yr", "mo")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(col).over(w).cast("decimal(20,0)")
    return (total / F.lit(10 ** scale) if scale else total).cast(MONEY)


LIFE_TO_DATE = ("purchases_ltd", "returns_ltd")


def _month_columns(life_to_date: bool = True) -> list[F.Column]:
    return [
        "account_id", "yr", "mo",
        F.lit(PRODUCT_CODE).alias("info_type"),
        "status_code",
        F.col("delinquency_level").cast("int").alias("delinquency_level"),
        F.when(F.col("max_tax") > 0, F.col("net_units").cast(MONEY)).alias("balance"),
        F.when(F.col("max_discount") > 0, (F.floor(F.col("min_price") / 2000) * 500).cast(MONEY))
        .alias("credit_limit"),
        "first_purchase_date",
        *([_life_to_date("purchase_cents", 2).alias("purchases_ltd"),
           _life_to_date("return_cents", 2).alias("returns_ltd")] if life_to_date else []),
    ]


def account_month(cm: DataFrame) -> DataFrame:
    return conform(cm.select(*_month_columns()), SCHEMAS["account_month"], "account_month")


def profit_month(cm: DataFrame) -> DataFrame:
    return conform(
        cm.where(F.col("profit_units").isNotNull())
        .select("account_id", "yr", "mo", _life_to_date("profit_units").alias("profit_ltd")),
        SCHEMAS["profit_month"], "profit_month")


def month_with_profit(cm: DataFrame) -> DataFrame:
    """``account_month`` with ``profit_ltd``, null in a month without a profit row."""
    profit = F.when(F.col("profit_units").isNotNull(), _life_to_date("profit_units"))
    return cm.select(*_month_columns(), profit.alias("profit_ltd"))


def accounts(raw: dict[str, DataFrame]) -> DataFrame:
    orders = raw["orders"]
    return conform(
        orders.where(F.col("o_orderstatus") == "F")
        .groupBy(F.col("o_custkey").alias("account_id"))
        .agg(F.min("o_orderdate").cast("date").alias("open_date")),
        SCHEMAS["accounts"], "accounts")


def account_openings(raw: dict[str, DataFrame]) -> DataFrame:
    """``accounts`` with several rows for many accounts: an account opens with its first
    completed order, and once more with its first order that is still open."""
    orders = raw["orders"]
    return conform(
        orders.where(F.col("o_orderstatus").isin("F", "O"))
        .groupBy(F.col("o_custkey").alias("account_id"), "o_orderstatus")
        .agg(F.min("o_orderdate").cast("date").alias("open_date")),
        SCHEMAS["accounts"], "accounts")


def applications(raw: dict[str, DataFrame]) -> DataFrame:
    """Status from the priority, risk level from the order's value, label from the nation."""
    orders, customer = raw["orders"], raw["customer"]
    prio = F.substring("o_orderpriority", 1, 1)
    price, nation = F.col("o_totalprice"), F.col("c_nationkey")
    bureau = (F.when(prio.isin("1", "2"), "HIT")
              .when(prio == "3", "THIN FILE")
              .when((prio == "5") & (price < 100_000), F.lit(None).cast("string"))
              .otherwise("NOHIT"))
    label = (F.when(nation < 7, " 1. bajo")
             .when(nation < 14, "2. Medio ")
             .when(nation < 20, "3. alto"))
    return conform(
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").select(
            F.col("o_custkey").alias("account_id"),
            F.col("o_orderdate").cast("date").alias("application_date"),
            F.when(F.col("o_orderstatus") == "P", OTHER_PRODUCT_CODE)
            .otherwise(PRODUCT_CODE).alias("org_code"),
            bureau.alias("bureau_hit"),
            F.when(nation != 24, F.col("c_acctbal").cast(MONEY)).alias("income"),
            F.when(price < 420_000, F.floor(price / 60_000).cast("int")).alias("risk_level"),
            label.alias("risk_label"),
            F.col("c_mktsegment").alias("score_segment"),
        ), SCHEMAS["applications"], "applications")


class DerivedTables:
    """The four portfolio tables derived from the test tables of ``sf_dir``.

    Same attributes as :class:`Tables`; each plan is built on first access,
    so a report that reads only applications never builds the monthly facts.
    ``openings``: an account's row per opening (``account_openings``) instead of one.
    """

    def __init__(self, raw: dict[str, DataFrame], openings: bool = False):
        self._raw = raw
        self.accounts_unique = not openings

    @property
    def reopened(self) -> "DerivedTables":
        """The same tables with a row per opening of an account."""
        return DerivedTables(self._raw, openings=True)

    @cached_property
    def _customer_month(self) -> DataFrame:
        return customer_month(self._raw)

    @cached_property
    def applications(self) -> DataFrame:
        return applications(self._raw)

    @cached_property
    def accounts(self) -> DataFrame:
        return accounts(self._raw) if self.accounts_unique else account_openings(self._raw)

    @cached_property
    def account_month(self) -> DataFrame:
        return account_month(self._customer_month)

    def recent_months(self, year_floor: int) -> DataFrame:
        """``account_month`` from a year on, without the columns that sum up an account's life;
        only those need the ship dates before it."""
        return customer_month(self._raw, year_floor).select(*_month_columns(life_to_date=False))

    @cached_property
    def profit_month(self) -> DataFrame:
        return profit_month(self._customer_month)

    @cached_property
    def month_with_profit(self) -> DataFrame:
        return month_with_profit(self._customer_month)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def load_tables(spark: SparkSession, sf_dir: str, openings: bool = False) -> TableSource:
    """Derive the four portfolio tables from the test tables in ``sf_dir`` (lazily)."""
    return DerivedTables(read_raw(spark, sf_dir), openings)
