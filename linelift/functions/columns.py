"""Column helpers for the semantics Spark's built-ins do not give directly.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` only, so
it stays inside whole-stage codegen (no Python UDF anywhere in the library).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label given to applications without a risk label.
UNIDENTIFIED_RISK_LABEL = "0. NO IDENTIFICADO"

# Every Unicode white-space character at either end, line ends included.
_TRIM_PATTERN = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """Ratio as DOUBLE, null when the divisor is 0 or either side is null.

    Plain ``/`` raises on a zero divisor under ANSI mode; ``try_divide`` returns
    null instead. Both sides are cast to double first so that the result type is
    the same whatever the input types (counts, decimals or doubles).
    """
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def floor_zero(x: Column | str) -> Column:
    """``GREATEST(x, 0)`` with null propagation.

    Spark's ``greatest`` skips nulls (``greatest(null, 0) = 0``); the source
    dialect returns null when any argument is null. ``x < 0`` is null for a
    null ``x``, so the ``otherwise`` branch returns the null unchanged. The
    result keeps the type of ``x``.
    """
    x = col_(x)
    return F.when(x < 0, F.lit(0)).otherwise(x)


def month_diff(later: Column | str, earlier: Column | str) -> Column:
    """Calendar month boundaries crossed from ``earlier`` to ``later``.

    2025-01-31 -> 2025-02-01 is 1 (``timestampdiff(MONTH)`` would say 0).
    Negative when ``later`` precedes ``earlier``; null if either is null.
    """
    later, earlier = col_(later), col_(earlier)
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def month_start(yr: Column | str, mo: Column | str) -> Column:
    """First day of the month ``(yr, mo)`` as a DATE."""
    return F.make_date(col_(yr), col_(mo), F.lit(1))


def trim_ws(x: Column | str) -> Column:
    """Strip leading and trailing Unicode white space (Spark's ``trim`` removes only spaces)."""
    return F.regexp_replace(col_(x), _TRIM_PATTERN, "")


def clean_label(x: Column | str) -> Column:
    """Risk label normalisation: null -> fixed label, then trim, then upper."""
    return F.upper(trim_ws(F.coalesce(col_(x).cast("string"), F.lit(UNIDENTIFIED_RISK_LABEL))))


def period_label(d: Column | str) -> Column:
    """'YYYY-MM' label of a date; null stays null."""
    return F.date_format(col_(d), "yyyy-MM")


def month_trunc(d: Column | str) -> Column:
    """First day of the month of ``d``, kept as DATE (``date_trunc`` gives a timestamp)."""
    return F.trunc(col_(d), "month")


def mean_of(x: Column | str, weight: Column | None = None) -> Column:
    """Mean of a decimal column as DOUBLE: exact decimal sum / non-null count.

    ``avg(decimal)`` returns a wider decimal in Spark; summing exactly and
    dividing once keeps the result independent of row order. With ``weight``,
    each row counts that many times.
    """
    x = col_(x)
    if weight is None:
        return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))
    return F.try_divide(F.sum(x * weight).cast("double"),
                        F.sum(F.when(x.isNotNull(), weight)).cast("double"))


def money_sum(x: Column | str) -> Column:
    """Exact decimal sum, widened to DECIMAL(38,2)."""
    return F.sum(col_(x)).cast("decimal(38,2)")


RATIO_BITS, AMOUNT_BITS = 40, 20


def fixed_sum(x: Column | str, bits: int = AMOUNT_BITS, weight: Column | None = None) -> Column:
    """Sum of doubles in units of 2^-``bits``, as a double; null without non-null values.

    Each value is rounded to a whole number of units and those are summed
    exactly, so the result does not depend on the order of the rows.
    """
    units = F.rint(col_(x) * float(2 ** bits)).cast("decimal(38,0)")
    if weight is not None:
        units = units * weight.cast("decimal(18,0)")
    return F.sum(units).cast("double") / float(2 ** bits)


def fixed_mean(x: Column | str, bits: int = RATIO_BITS, weight: Column | None = None) -> Column:
    """Mean of the non-null doubles, from ``fixed_sum``."""
    count = F.count(col_(x)) if weight is None else F.sum(F.when(col_(x).isNotNull(), weight))
    return safe_divide(fixed_sum(x, bits, weight), count)
