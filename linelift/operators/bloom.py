"""Bloom filters as Spark SQL expressions: rows that cannot join go before the exchange.

A filter is one array of 64-bit words, built by Spark as a scalar subquery of the plan that
uses it. Its size follows from the number of keys, which the same plan counts, and is
bounded, so broadcasting it is safe at any size. Rows that it keeps by mistake cost time only:
a join behind it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
"""With PROBES, less than 1 in 100 foreign keys passes (while the filter is below its bound)."""
PROBES = 4
LEAST_WORDS, MOST_WORDS = 1 << 6, 1 << 18
"""64-bit words of a filter: 2 MB at most, which holds 1.4 million keys at BITS_PER_KEY. With 8 times
as many keys four of five foreign rows pass; the filter then saves little, and costs no more."""


def _probe(key: Column, number: int) -> Column:
    """A 62-bit hash of the key, another for each number."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(number)), 2)


def bloom_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row with ``words``: the filter of all keys of ``keys`` that are not null, as
    array<bigint> of a power of two of elements."""
    column = F.col(key)
    keys = keys.select(key).where(column.isNotNull()).distinct()
    # words = the next power of two of count * BITS_PER_KEY / 64, within the bounds
    count = keys.agg(F.count(F.lit(1))).scalar()
    wanted = F.ceil(F.log2(F.greatest(count * BITS_PER_KEY / F.lit(64.0), F.lit(1.0))))
    words = F.least(F.lit(MOST_WORDS), F.greatest(
        F.lit(LEAST_WORDS), F.pow(F.lit(2.0), wanted).cast("bigint"))).cast("bigint")
    bits = (keys.select(F.explode(F.array(*[_probe(column, i) for i in range(PROBES)])).alias("h"))
            .select(F.pmod(F.shiftright("h", 6), words).alias("word"),
                    F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")))
    empty = keys.sparkSession.range(MOST_WORDS).where(F.col("id") < words).select(
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    dense = bits.unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))),
                                 lambda w: w["bit"]).alias("words"))


def may_contain(keys: DataFrame, key: str, column: Column | str | None = None) -> Column:
    """Whether ``column`` (default: the column ``key``) may be one of the keys of ``keys``: true for
    every key, false for a null and for most other values."""
    column = F.col(key if column is None else column) if not isinstance(column, Column) else column
    words = bloom_filter(keys, key).scalar()
    size = F.size(words).cast("bigint")
    out = column.isNotNull()
    for i in range(PROBES):
        h = _probe(column, i)
        word = F.get(words, F.pmod(F.shiftright(h, 6), size).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int"))
        out = out & (bit.bitwiseAND(F.lit(1)) == 1)
    return out
