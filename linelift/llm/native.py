"""Spark SQL expressions that several native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """For each element of an array of long, the sum of those before it.

    Sums are made in blocks of SUM_BLOCK and moved by the blocks' own running sums, as appending to
    one growing array copies it each time.
    """
    none = F.array().cast("array<bigint>")

    def sums(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def of(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(SUM_BLOCK)).cast("int")
        starts = F.sequence(F.lit(0), count - 1)
        return bound(F.transform(starts, lambda b: sums(F.slice(values, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))), moved)

    def moved(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: b["at"])
        return bound(sums(totals), lambda offsets: F.flatten(F.transform(
            blocks, lambda b, i: F.transform(b["out"], lambda x: x + F.get(offsets["out"], i)))))

    return F.when(F.size(numbers) > 0, bound(numbers, of)).otherwise(none)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
