"""What-if credit-line scenario: new limit, peer benchmarks, projections, totals."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelift.functions.bands import TARGET_LIMIT, TARGET_MIN_INCOME
from linelift.functions.columns import (RATIO_BITS, fixed_mean, fixed_sum, floor_zero, money_sum,
                                        safe_divide)
from linelift.operators.skew import weight_of
from linelift.sources.schema import MONEY

BENCHMARK_KEYS = ("bureau_hit", "score_segment", "risk_label", "new_limit")
RATE_MILESTONES = (2, 3, 6, 9)
UTIL_MILESTONES = (2, 3, 6, 9, 12)
PROJECTED_MILESTONES = (2, 3, 6, 9)
REPORTED_MILESTONES = (2, 3, 9)


def _money(v) -> Column:
    return F.lit(Decimal(v)).cast(MONEY)


def what_if_limit(df: DataFrame, *, floor: int = TARGET_LIMIT, min_income: int = TARGET_MIN_INCOME,
                  limit: str = "credit_limit", income: str = "income",
                  high_income: Column | None = None) -> DataFrame:
    """Raise the limit to ``floor`` when income >= ``min_income`` and limit < ``floor``.

    ``high_income``: the income test's outcome, if ``income`` was collapsed to it.
    """
    high = F.col(income) >= min_income if high_income is None else high_income
    raise_it = high & (F.col(limit) < floor)
    return df.withColumn("new_limit", F.when(raise_it, _money(floor)).otherwise(F.col(limit)))


def target_limit(df: DataFrame, *, floor: int = TARGET_LIMIT,
                 limit: str = "credit_limit") -> DataFrame:
    """D8, target variant: keep accounts with limit < ``floor``, all raised to ``floor``."""
    return df.where(F.col(limit) < floor).withColumn("new_limit", _money(floor))


def _peer_limit(lines: DataFrame) -> Column:
    """The limit that goes with a line's balances: its own, where accounts have several rows."""
    return F.col("peer_limit" if "peer_limit" in lines.columns else "credit_limit")


def peer_benchmarks(scenario: DataFrame, keys: Sequence[str] = BENCHMARK_KEYS) -> DataFrame:
    """Per peer group, delinquency rates (ratio of sums) and mean utilisations.

    ``rate_dq_{m}m`` = delinquent accounts / present accounts at MOB m;
    ``util_{m}m`` / ``util_dq_{m}m`` = mean of balance / limit over the group's
    rows (a 0 or null limit gives a null ratio, which the mean skips).
    The output has one row per group, so it is small whatever the input size.
    """
    lim = _peer_limit(scenario)
    aggs = [safe_divide(F.sum(f"accts_dq_{m}m"), F.sum(f"accts_{m}m")).alias(f"rate_dq_{m}m")
            for m in RATE_MILESTONES]
    for m in UTIL_MILESTONES:
        aggs.append(fixed_mean(safe_divide(floor_zero(f"bal_dq_{m}m"), lim))
                    .alias(f"util_dq_{m}m"))
        aggs.append(fixed_mean(safe_divide(floor_zero(f"bal_{m}m"), lim)).alias(f"util_{m}m"))
    return scenario.groupBy(*keys).agg(*aggs)


def attach_benchmarks(scenario: DataFrame, benchmarks: DataFrame,
                      keys: Sequence[str] = BENCHMARK_KEYS) -> DataFrame:
    """Left equi-join on the peer keys: a row with any null key gets no benchmark.

    Only rows without a positive limit are projected by their peers, so only
    those are joined; the others keep null benchmarks. A peer group has one row
    in ``benchmarks``, so this side may be joined from a written or measured
    table without fan-out.
    """
    own = F.coalesce(F.col("credit_limit") > 0, F.lit(False))
    added = [c for c in benchmarks.columns if c not in keys]
    types = dict(benchmarks.dtypes)
    alone = scenario.where(own).withColumns({c: F.lit(None).cast(types[c]) for c in added})
    return alone.unionByName(scenario.where(~own).join(benchmarks, list(keys), "left"))


def project_balances(df: DataFrame, milestones: Sequence[int] = PROJECTED_MILESTONES) -> DataFrame:
    """Balances under the new limit.

    With a positive limit: balance / limit x new limit. Otherwise the peer mean
    utilisation x new limit, and for delinquent balances also x the peer rate.
    """
    lim, new = F.col("credit_limit"), F.col("new_limit")
    has_limit = lim > 0
    cols = {}
    for m in milestones:
        cols[f"bal_{m}m_new"] = (F.when(has_limit, safe_divide(floor_zero(f"bal_{m}m"), lim) * new)
                                 .otherwise(F.col(f"util_{m}m") * new))
        cols[f"bal_dq_{m}m_new"] = (
            F.when(has_limit, safe_divide(floor_zero(f"bal_dq_{m}m"), lim) * new)
            .otherwise(F.col(f"util_dq_{m}m") * new * F.col(f"rate_dq_{m}m")))
    return df.withColumns(cols)


def scenario_totals(projected: DataFrame, keys: Sequence[str] = ("bureau_hit", "risk_label"),
                    milestones: Sequence[int] = REPORTED_MILESTONES) -> DataFrame:
    """Per group, rows, accounts, and actual vs projected balance sums."""
    aggs = [
        F.count(F.lit(1)).alias("applications"),
        F.sum(F.when(F.col("account_id") > 0, 1).otherwise(0)).cast("bigint").alias("accounts"),
    ]
    for m in milestones:
        aggs += [money_sum(f"bal_{m}m").alias(f"total_bal_{m}m"),
                 money_sum(f"bal_dq_{m}m").alias(f"total_bal_dq_{m}m")]
    for m in milestones:
        aggs += [fixed_sum(f"bal_{m}m_new").alias(f"total_bal_{m}m_new"),
                 fixed_sum(f"bal_dq_{m}m_new").alias(f"total_bal_dq_{m}m_new")]
    return projected.groupBy(*keys).agg(*aggs)


def _add_skipping_nulls(a: Column, b: Column) -> Column:
    """a + b where a null operand counts as absent; null only if both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
        F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def grouped_scenario_totals(lines: DataFrame, keys: Sequence[str] = ("bureau_hit", "risk_label"),
                            bench_keys: Sequence[str] = BENCHMARK_KEYS,
                            milestones: Sequence[int] = REPORTED_MILESTONES) -> DataFrame:
    """D11 + D12 + D13 in two aggregations, without joining benchmarks back.

    A row without a positive limit is projected as (peer mean utilisation x new
    limit [x peer rate]); all three factors are constant inside a peer group
    (``new_limit`` is a peer key). So the projected sum of a group is its own
    rows' sum plus that constant times the group's count of such rows, and a
    group with a null key gets no peer term (an equi-join never matches it). The
    same totals as :func:`scenario_totals` over :func:`project_balances`, with
    one pass over the lines: partial aggregation handles hot peer groups, and
    nothing joins a large table to a low-cardinality one. Collapsed lines count
    as often as their weight.
    """
    lim, new, n = F.col("credit_limit"), F.col("new_limit"), weight_of(lines)
    has_limit = lim > 0
    aggs = [
        F.sum(n).alias("n_rows"),
        F.sum(F.when(F.col("account_id") > 0, n).otherwise(0)).alias("n_accounts"),
        F.sum(F.when(F.coalesce(has_limit, F.lit(False)), 0).otherwise(n)).alias("n_peer"),
    ]
    for m in milestones:
        use, use_dq = (safe_divide(floor_zero(f"{c}_{m}m"), lim) for c in ("bal", "bal_dq"))
        peer, peer_dq = (safe_divide(floor_zero(f"{c}_{m}m"), _peer_limit(lines)) for c in ("bal", "bal_dq"))
        aggs += [
            safe_divide(F.sum(F.col(f"accts_dq_{m}m") * n), F.sum(F.col(f"accts_{m}m") * n))
            .alias(f"rate_dq_{m}m"),
            fixed_mean(peer, RATIO_BITS, n).alias(f"util_{m}m"),
            fixed_mean(peer_dq, RATIO_BITS, n).alias(f"util_dq_{m}m"),
            fixed_sum(F.when(has_limit, use * new), weight=n).alias(f"own_{m}m"),
            fixed_sum(F.when(has_limit, use_dq * new), weight=n).alias(f"own_dq_{m}m"),
            F.sum(F.col(f"bal_{m}m") * n).alias(f"act_{m}m"),
            F.sum(F.col(f"bal_dq_{m}m") * n).alias(f"act_dq_{m}m"),
        ]
    groups = lines.groupBy(*bench_keys).agg(*aggs)
    matched = F.lit(True)
    for k in bench_keys:
        matched &= F.col(k).isNotNull()
    peer = matched & (F.col("n_peer") > 0)
    n_peer = F.col("n_peer").cast("double")
    groups = groups.withColumns({
        **{f"peer_{m}m": F.when(peer, F.col(f"util_{m}m") * new * n_peer) for m in milestones},
        **{f"peer_dq_{m}m": F.when(peer, F.col(f"util_dq_{m}m") * new * F.col(f"rate_dq_{m}m")
                                   * n_peer) for m in milestones},
    })
    out = [F.sum("n_rows").alias("applications"),
           F.sum("n_accounts").cast("bigint").alias("accounts")]
    for m in milestones:
        out += [money_sum(f"act_{m}m").alias(f"total_bal_{m}m"),
                money_sum(f"act_dq_{m}m").alias(f"total_bal_dq_{m}m")]
    for m in milestones:
        out += [_add_skipping_nulls(fixed_sum(f"own_{m}m"), fixed_sum(f"peer_{m}m"))
                .alias(f"total_bal_{m}m_new"),
                _add_skipping_nulls(fixed_sum(f"own_dq_{m}m"), fixed_sum(f"peer_dq_{m}m"))
                .alias(f"total_bal_dq_{m}m_new")]
    return groups.groupBy(*keys).agg(*out)


def delinquency_ratios(totals: DataFrame, keys: Sequence[str] = ("bureau_hit", "risk_label"),
                       milestones: Sequence[int] = REPORTED_MILESTONES,
                       digits: int = 9) -> DataFrame:
    """Delinquent / total balance, actual and projected, per milestone.

    Ratios are reported at ``digits`` decimals, the scale of the source
    warehouse's NUMERIC.
    """
    cols = [*keys, "applications", "accounts"]
    for m in milestones:
        cols += [
            F.round(safe_divide(f"total_bal_dq_{m}m", f"total_bal_{m}m"), digits)
            .alias(f"dq_rate_{m}m_actual"),
            F.round(safe_divide(f"total_bal_dq_{m}m_new", f"total_bal_{m}m_new"), digits)
            .alias(f"dq_rate_{m}m_new"),
        ]
    return totals.select(*cols)
