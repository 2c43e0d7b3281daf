"""The account profile as a mergeable state: new months are folded in without the old ones.

Every column of the profile is a maximum over an account's months, or comes from two of them (the
origination limit: the largest at MOB <= 1, else the largest ever). So the state of two
sets of months, overlapping or not, is the maximum of their states, column by column. A
month that comes late, or twice, changes nothing but what it should.

A state has one row per (account_id, open_date) with a month in it. ``finish`` turns it into
the profile that ``plans.batch`` and the reports read. Stored states are bucketed by account,
like the tables. Folding in a month moves one row per account of the state, no month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelift.operators.facts import is_open, months_on_book, net_placement
from linelift.operators.profiles import activation_flag, milestone_delinquency, milestone_values
from linelift.plans.params import DEFAULT, Params
from linelift.sources.schema import TableSource
from linelift.sources.warehouse import default_buckets, open_bucketed, write_bucketed

KEYS = ["account_id", "open_date"]


def profile_state(months: DataFrame, accounts: DataFrame, p: Params = DEFAULT,
                  accounts_unique: bool = True) -> DataFrame:
    """The state of ``months`` (rows of ``account_month``, any choice of them)."""
    rows = months.where(is_open(p.info_type, p.closed_statuses) & (F.col("yr") >= p.year_floor))
    fact = (months_on_book(rows, accounts, unique=accounts_unique)
            .withColumn("placed", net_placement()))
    return fact.groupBy(*KEYS).agg(
        F.max(F.when(F.col("mob") <= 1, F.col("credit_limit"))).alias("early_limit"),
        F.max("credit_limit").alias("any_limit"),
        *milestone_delinquency(dict(p.delinquency_levels)),
        *milestone_values("placed", p.horizons, prefix="placed"),
        activation_flag(months=p.activation_months).alias("activated_3m"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all months of ``states`` together.

    The rows are dealt by account here, one per account and state, whatever their storage: Spark 4.1
    takes a union of bucketed tables for partitioned by the bucket key and then reads them
    without buckets, which would leave an account in several groups.
    """
    rows = reduce(DataFrame.unionByName, states).repartition("account_id")
    return rows.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in rows.columns if c not in KEYS])


def finish(state: DataFrame) -> DataFrame:
    """The profile: the state with its origination limit."""
    rest = [c for c in state.columns if c not in (*KEYS, "early_limit", "any_limit")]
    return state.select(*KEYS, F.coalesce("early_limit", "any_limit").alias("credit_limit"), *rest)


def folded_by_year(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    """The profile of all months, from a state of the first year read and one of all later
    years. The parts are aggregated alone and meet as one row per account each."""
    first = F.col("yr") == p.year_floor
    states = [profile_state(t.account_month.where(part), t.accounts, p, t.accounts_unique)
              for part in (first, ~first)]
    return finish(merge_states(*states))


def write_state(state: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store a state in buckets of accounts at a new ``path``."""
    write_bucketed(state, path, buckets or default_buckets(state.sparkSession))


def read_state(spark: SparkSession, path: str, name: str, buckets: int | None = None) -> DataFrame:
    """A stored state, through the catalog's table ``name``; ``buckets`` as it was written."""
    schema = spark.read.parquet(path).schema
    return open_bucketed(spark, path, schema, buckets or default_buckets(spark), name)
