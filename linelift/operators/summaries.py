"""Report-level summaries: shares, side-by-side counts, pivots, limit statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linelift.functions.columns import mean_of, money_sum, safe_divide
from linelift.operators.skew import weight_of

RISK_LEVELS = tuple(range(6))


def count_by_status(df: DataFrame, key: str, statuses: Sequence[str] = ("HIT", "NOHIT"),
                    status_col: str = "bureau_hit") -> DataFrame:
    """Per ``key``, one count column per status plus the count of all rows
    (collapsed rows count as often as their weight)."""
    n = weight_of(df)
    aggs = [F.sum(F.when(F.col(status_col) == s, n).otherwise(0))
            .alias(f"accounts_{s.lower().replace(' ', '_')}") for s in statuses]
    return df.groupBy(key).agg(*aggs, F.sum(n).alias("accounts_total"))


def share_of_total(counts: DataFrame, count_cols: Sequence[str],
                   share_cols: Sequence[str]) -> DataFrame:
    """Each count over its column's grand total (null when the total is 0).

    The grand totals are scalar subqueries over a two-step aggregation, so
    ``counts`` may have any number of rows and is never gathered in one task.
    """
    return counts.withColumns({
        share: safe_divide(F.col(c), counts.agg(F.sum(c)).scalar())
        for c, share in zip(count_cols, share_cols)
    })


def share_of_partition(counts: DataFrame, keys: Sequence[str], count_col: str,
                       total_col: str, share_col: str) -> DataFrame:
    """A count, its partition total and its share of that total.

    ``counts`` is already aggregated (one row per key x level), so the window
    only moves those summary rows.
    """
    w = Window.partitionBy(*keys)
    total = F.sum(count_col).over(w)
    return counts.withColumns({total_col: total, share_col: safe_divide(F.col(count_col), total)})


def pivot_risk_levels(df: DataFrame, key: Column, levels: Sequence[int] = RISK_LEVELS,
                      level_col: str = "risk_level") -> DataFrame:
    """Per key, the row count and one zero-filled count per listed level.

    One aggregation with a conditional count per level; the total counts rows
    of levels outside the list too. Equivalent to counting per level first and
    then summing the counts, without the second shuffle.
    """
    lvl = F.col(level_col)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_applications"),
        *[F.count_if(lvl == v).alias(f"applications_r{v}") for v in levels],
    )


def limit_summary(df: DataFrame, key: str, current: str = "credit_limit",
                  new: str = "new_limit") -> DataFrame:
    """Rows, and rounded mean / min / max of the current and the new limit."""
    n = weight_of(df)
    aggs = [F.sum(n).alias("total_accounts")]
    for col, tag in ((current, "current"), (new, "new")):
        aggs += [F.round(mean_of(col, n), 2).alias(f"avg_limit_{tag}"),
                 F.min(col).alias(f"min_limit_{tag}"),
                 F.max(col).alias(f"max_limit_{tag}")]
    return df.groupBy(key).agg(*aggs)


def roi_by_horizon(df: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (6, 9, 12),
                   unique_accounts: bool = False) -> DataFrame:
    """Distinct accounts, mean limit, and per horizon placement, profit, ratio.

    Numerator and denominator of each ratio are summed over their own non-null
    rows. ``unique_accounts``: an account has one row per group, so counting rows
    counts accounts, without the extra grouping of a distinct count.
    """
    accounts = F.count("account_id") if unique_accounts else F.count_distinct("account_id")
    aggs = [accounts.alias("total_accounts"),
            F.round(mean_of("credit_limit"), 2).alias("avg_limit")]
    for h in horizons:
        placed, profit = F.col(f"placed_{h}m"), F.col(f"profit_{h}m")
        aggs += [money_sum(placed).alias(f"placed_{h}m"),
                 money_sum(profit).alias(f"profit_{h}m"),
                 safe_divide(F.sum(profit), F.sum(placed)).alias(f"lroi_{h}m")]
    return df.groupBy(*keys).agg(*aggs)
