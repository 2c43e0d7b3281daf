"""Credit-limit bands (D9) as one chained ``CASE`` expression."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from linelift.functions.columns import col_

# Band labels exactly as the reports print them, in order.
BAND_LABELS = (
    "a. Mínima Target (Ing>=4k | LC<4k)",
    "b. [Mínima, 4000) General",
    "c. [4000, 6000)",
    "d. [6000, 8000)",
    "e. [8000, 10000)",
    "f. [10000, 15000)",
    "g. [15000, 20000)",
    "h. [20000, o más)",
    "i. Otros / Fuera de Rango",
)

# Band edges and the income that makes an account a target.
BAND_EDGES = (4000, 6000, 8000, 10000, 15000, 20000)
TARGET_LIMIT = 4000
TARGET_MIN_INCOME = 4000


def band_conditions(limit: Column, income: Column | None, edges=BAND_EDGES,
                    target_limit=TARGET_LIMIT, min_income=TARGET_MIN_INCOME,
                    high_income: Column | None = None) -> list[Column]:
    """Predicates for bands a..h in order; the first that holds wins, none -> i.

    ``high_income``: whether the income reaches ``min_income``, if it is known
    already (then ``income`` is not read).
    """
    if high_income is None:
        high_income = income >= F.lit(Decimal(min_income))
    conds = [
        high_income & (limit < F.lit(Decimal(target_limit))),
        limit < F.lit(Decimal(edges[0])),
    ]
    for lo, hi in zip(edges, edges[1:]):
        conds.append((limit >= F.lit(Decimal(lo))) & (limit < F.lit(Decimal(hi))))
    conds.append(limit >= F.lit(Decimal(edges[-1])))
    return conds


def limit_band(limit: Column | str, income: Column | str | None = None, labels=BAND_LABELS,
               **kw) -> Column:
    """Band label of an account from its origination limit and income.

    Null income never satisfies band a, so it falls to b when the limit is
    below the first edge; a null limit satisfies nothing and lands in i.
    """
    conds = band_conditions(col_(limit), None if income is None else col_(income), **kw)
    if len(labels) != len(conds) + 1:
        raise ValueError(f"need {len(conds) + 1} labels, got {len(labels)}")
    expr = F.when(conds[0], F.lit(labels[0]))
    for cond, label in zip(conds[1:], labels[1:]):
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))
