"""Joins of applications to accounts when one account holds a large share of the rows.

AQE splits a skewed partition only where both sides of the join are shuffled
for it; next to a per-account aggregate one side is not, so a hot account would
stay in one task. Summaries avoid it by collapsing the applications first,
row-level results by salting the hot accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "n_applications"
HOT_SHARE = 1024
SALTS = 64


def collapse(applications: DataFrame, *keys: Column | str) -> DataFrame:
    """Applications that agree in ``keys`` as one row with their number.

    The keys are the account and a few low-cardinality columns, so partial
    aggregation leaves an account a bounded number of rows before any shuffle.
    """
    return applications.groupBy(*keys).agg(F.count(F.lit(1)).alias(WEIGHT))


def weight_of(df: DataFrame) -> Column:
    """The number of applications a row stands for (1 for uncollapsed rows)."""
    return F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1).cast("bigint")


def hot_keys(rows: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """(_hot): every key that holds more than one in ``share`` of the rows, and few others.

    One pass with a frequent-items summary per task instead of a shuffle by key. With m
    counters a summary misses no key of more than 3.5 / m of the rows and overstates a key by
    that much at most. At 8 counters (a power of two of at least 16 after Spark's load factor) per
    key of the share, no hot key is missed, and the keys that seem hot number 1.3 ``share`` at most,
    so they all are among the 2 ``share`` largest, and broadcasting them is safe.
    """
    found = rows.agg(F.expr(f"approx_top_k(`{key}`, {2 * share}, {8 * share})").alias("top"),
                     F.count(F.lit(1)).alias("total"))
    return (found.select(F.explode("top").alias("t"), "total")
            .where(F.col("t.item").isNotNull() & (F.col("t.count") * share > F.col("total")))
            .select(F.col("t.item").alias("_hot")))


def salted_join(applications: DataFrame, per_account: DataFrame, key: str = "account_id",
                share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key`` that deals the rows of hot keys to ``salts`` tasks.

    A key is hot if it holds more than one in ``share`` of the applications
    (``hot_keys``). ``per_account`` has few rows per key; those of hot keys are copied
    once per salt.
    """
    hot = F.broadcast(hot_keys(applications, key, share))  # fewer than 2 ``share`` rows
    dealt = F.when(F.col("_hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1)))
    left = (applications.join(hot, F.col(key) == F.col("_hot"), "left")
            .withColumn("_salt", F.coalesce(dealt, F.lit(0)).cast("int")).drop("_hot"))
    right = (per_account.join(hot, F.col(key) == F.col("_hot"), "left")
             .withColumn("_salt", F.explode(F.coalesce(copies, F.array(F.lit(0))))).drop("_hot"))
    return left.join(right, [key, "_salt"], "inner").drop("_salt")
