"""The nine reports, each a function ``(TableSource, Params) -> DataFrame``; the
optional ``profile`` keyword lets ``plans.batch`` share one per-account profile.

Plans are declared with the DataFrame API; Catalyst pushes the filters into
the Parquet scans and AQE picks join strategies from measured sizes. The only
wide step over the monthly fact is one per-account aggregate, restricted by a
semi join to the accounts the report can keep before any other join. The
applications are collapsed to a few rows per account before they meet it, so an
account with very many applications is no hot join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelift.functions.bands import limit_band
from linelift.functions.columns import (UNIDENTIFIED_RISK_LABEL, mean_of, month_trunc,
                                        period_label, safe_divide)
from linelift.operators.facts import (ALL_BUREAU, HIT_NOHIT, distinct_universe,
                                      eligible_applications, is_open, latest_applications,
                                      months_on_book, net_placement, open_account_months)
from linelift.operators.profiles import (account_pairs, account_profile, activation_flag,
                                         delinquency_columns,
                                         milestone_delinquency, milestone_values,
                                         origination_limit, profit_milestones, restrict)
from linelift.operators.scenario import (attach_benchmarks, delinquency_ratios,
                                         grouped_scenario_totals, peer_benchmarks,
                                         project_balances, target_limit, what_if_limit)
from linelift.operators.skew import collapse, salted_join, weight_of
from linelift.operators.summaries import (count_by_status, limit_summary, pivot_risk_levels,
                                          roi_by_horizon, share_of_partition, share_of_total)
from linelift.plans.params import DEFAULT, Params
from linelift.sources.schema import TableSource


# ---------------------------------------------------------------- shared steps

def _prefilter(t: TableSource, p: Params) -> bool:
    """Facts in buckets are not shuffled, so there is nothing to spare."""
    return p.prefilter_accounts and getattr(t, "account_buckets", None) is None


def open_months(t: TableSource, p: Params, year_floor: int, life_to_date: bool) -> DataFrame:
    """D7. Without ``life_to_date`` the columns that count from an account's opening on may be
    missing; a source that derives them can then leave out the months before the floor."""
    recent = None if life_to_date else getattr(t, "recent_months", None)
    months = t.account_month if recent is None else recent(year_floor)
    return open_account_months(months, info_type=p.info_type, year_floor=year_floor,
                               excluded_statuses=p.closed_statuses)


def month_fact(t: TableSource, p: Params, how: str = "left", year_floor: int | None = None,
               universe: DataFrame | None = None, life_to_date: bool = True) -> DataFrame:
    """Open monthly rows of the product with ``open_date`` and ``mob`` (D7 + D1),
    of the accounts in ``universe`` if given."""
    months = open_months(t, p, p.year_floor if year_floor is None else year_floor, life_to_date)
    return months_on_book(restrict(months, universe, prefilter=_prefilter(t, p)), t.accounts, how,
                          t.accounts_unique)


def _latest(apps: DataFrame, p: Params) -> DataFrame:
    return latest_applications(apps) if p.dedupe_applications else apps


def window_applications(t: TableSource, p: Params, **kw) -> DataFrame:
    return _latest(eligible_applications(t.applications, org_code=p.org_code,
                                         date_from=p.window_from, date_to=p.window_to, **kw), p)


def high_income(p: Params) -> Column:
    """All the reports ask of the income: whether it reaches the target minimum."""
    return (F.col("income") >= p.min_income).alias("high_income")


def band_column(p: Params, **kw) -> Column:
    return limit_band("credit_limit", labels=p.band_labels, edges=p.band_edges,
                      target_limit=p.target_limit, min_income=p.min_income, **kw)


def account_limits(t: TableSource, p: Params, universe: DataFrame,
                   profile: DataFrame | None = None, by_account: bool = False) -> DataFrame:
    """account_id, open_date and origination limit of the accounts in ``universe``.

    ``profile``: a precomputed per-account profile (``plans.batch``) to read
    instead of aggregating the monthly fact again. ``by_account``: one row per account
    where accounts have several opening dates (D2 has both grains in the source).
    """
    if profile is not None:
        return profile.select("account_id", "open_date", "credit_limit")
    by_account = by_account and not t.accounts_unique
    return account_profile(month_fact(t, p, universe=universe, life_to_date=False),
                           ("account_id",) if by_account else ("account_id", "open_date"))


def banded(t: TableSource, p: Params, apps: DataFrame, *keys: str,
           profile: DataFrame | None = None) -> DataFrame:
    """Applications collapsed to account, ``keys`` and income class, with their band (R2, R7: the
    limit is the account's, over all its opening dates)."""
    lines = collapse(apps, "account_id", *keys, high_income(p))
    return (lines.join(account_limits(t, p, lines, profile, by_account=True), "account_id", "inner")
            .withColumn("limit_band", band_column(p, high_income=F.col("high_income"))))


def banded_universe(t: TableSource, p: Params, apps: DataFrame) -> DataFrame:
    """One row per application with its account's origination limit and band."""
    limits = account_limits(t, p, apps).drop("open_date")
    return salted_join(apps, limits).withColumn("limit_band", band_column(p, income="income"))


# ---------------------------------------------------------------- R1

def roi_universe(t: TableSource, p: Params, reported: bool = False) -> DataFrame:
    """D22; with ``reported`` only the statuses and labels that R1 can print."""
    base = distinct_universe(t.applications, org_code=p.org_code, date_from=p.roi_from,
                             bureau_in=ALL_BUREAU if reported else None)
    return base.where(F.col("risk_label") != UNIDENTIFIED_RISK_LABEL) if reported else base


def _placed_and_profit(t: TableSource, p: Params, base: DataFrame,
                       profile: DataFrame | None) -> DataFrame:
    """Per account of ``base``: open_date, origination limit, placement and profit at the horizons.

    Placement and limit come from open rows, profit from any row. Where the
    source offers both facts on one row, one aggregate reads the fact once.
    """
    months = getattr(t, "month_with_profit", None)
    shared = profile is not None and p.roi_year_floor == p.year_floor
    if months is not None and not shared and t.accounts_unique:
        rows = restrict(months.where(F.col("yr") >= p.roi_year_floor), base,
                        prefilter=_prefilter(t, p))
        rows = months_on_book(rows, t.accounts, "inner", t.accounts_unique).withColumn(
            "is_open", F.coalesce(is_open(p.info_type, p.closed_statuses), F.lit(False)))
        at_open = F.col("is_open")
        return (rows.groupBy("account_id", "open_date").agg(
            F.max("is_open").alias("any_open"),
            origination_limit(limit=F.when(at_open, F.col("credit_limit"))).alias("credit_limit"),
            *milestone_values(F.when(at_open, net_placement()), p.horizons, "placed"),
            *milestone_values("profit_ltd", p.horizons, "profit"))
            .where("any_open").drop("any_open"))
    if shared:  # months on book with an inner join = rows with an open date
        placed = profile.where(F.col("open_date").isNotNull()).select(
            "account_id", "open_date", "credit_limit", *[f"placed_{m}m" for m in p.horizons])
    else:
        fact = month_fact(t, p, "inner", p.roi_year_floor, base)
        placed = account_profile(fact.withColumn("placed", net_placement()),
                                 ("account_id", "open_date"),
                                 *milestone_values("placed", p.horizons, "placed"))
    profit = profit_milestones(t.profit_month, t.accounts, base, year_floor=p.roi_year_floor,
                               months=p.horizons, unique=t.accounts_unique,
                               prefilter=_prefilter(t, p))
    return placed.join(profit, "account_id", "left")


def roi_accounts(t: TableSource, p: Params, profile: DataFrame | None = None) -> DataFrame:
    """Per account x status x label below the target limit: limit, placement and profit.

    Every aggregate reads only the account's own monthly rows, so it is the same
    for each of the account's labels: aggregate per account, then attach them.
    """
    base = roi_universe(t, p, reported=True)
    labels = base.select("account_id", "bureau_hit", "risk_label").distinct()
    return (_placed_and_profit(t, p, base, profile)
            .where(F.col("credit_limit") < p.target_limit)
            .join(labels, "account_id", "inner")
            .withColumn("open_period", period_label("open_date")))


def lroi_by_cohort(t: TableSource, p: Params = DEFAULT, *,
                   profile: DataFrame | None = None) -> DataFrame:
    """Return on lending (cumulative profit / net placement) at 6, 9 and 12
    months on book, per opening month x bureau status x risk label, for
    accounts whose origination limit is below the target limit."""
    return (roi_by_horizon(roi_accounts(t, p, profile),
                           ["open_period", "bureau_hit", "risk_label"], p.horizons,
                           unique_accounts=t.accounts_unique)
            .orderBy("open_period", "bureau_hit", "risk_label"))


# ---------------------------------------------------------------- R2

def limit_band_distribution(t: TableSource, p: Params = DEFAULT, *,
                            profile: DataFrame | None = None) -> DataFrame:
    """R2: accounts per limit band, HIT / NOHIT / all, and each column's shares."""
    apps = window_applications(t, p, bureau_in=HIT_NOHIT)
    counts = count_by_status(banded(t, p, apps, "bureau_hit", profile=profile), "limit_band")
    return (share_of_total(counts, ["accounts_hit", "accounts_nohit", "accounts_total"],
                           ["share_hit", "share_nohit", "share_total"])
            .orderBy("limit_band"))


# ---------------------------------------------------------------- R3

def avg_limit_trend(t: TableSource, p: Params = DEFAULT, *,
                    profile: DataFrame | None = None) -> DataFrame:
    """Mean origination limit per opening month and bureau status."""
    apps = _latest(eligible_applications(t.applications, org_code=p.org_code,
                                         date_from=p.trend_after, from_strict=True,
                                         bureau_in=HIT_NOHIT), p)
    lines = collapse(apps, "account_id", "bureau_hit")
    joined = lines.join(account_limits(t, p, lines, profile), "account_id", "inner")
    return (joined.groupBy(period_label("open_date").alias("open_period"), "bureau_hit")
            .agg(mean_of("credit_limit", weight_of(joined)).alias("avg_limit"))
            .orderBy("open_period", "bureau_hit"))


# ---------------------------------------------------------------- R4 / R8

def _scenario_applications(t: TableSource, p: Params, target: bool,
                           statuses: tuple[str, ...] | None) -> DataFrame:
    date_from, date_to = (p.target_from, p.target_to) if target else (p.window_from, p.window_to)
    apps = _latest(eligible_applications(t.applications, org_code=p.org_code, date_from=date_from,
                                         date_to=date_to, bureau_in=statuses), p)
    return apps.select("account_id", "income", "bureau_hit", "score_segment",
                       F.upper("risk_label").alias("risk_label"))


def _delinquency_profile(t: TableSource, p: Params, universe: DataFrame, target: bool,
                         profile: DataFrame | None = None) -> DataFrame:
    levels = dict(p.delinquency_levels)
    floor = p.r8_year_floor if target else p.year_floor
    if profile is not None and floor == p.year_floor:
        shared = profile.select("account_id", "open_date", "credit_limit",
                                *delinquency_columns(levels))
        return shared if t.accounts_unique else account_pairs(shared)
    found = account_profile(month_fact(t, p, year_floor=floor, universe=universe, life_to_date=False),
                            ("account_id", "open_date"), *milestone_delinquency(levels))
    return found if t.accounts_unique else account_pairs(found)


def scenario_lines(t: TableSource, p: Params, *, target: bool = False,
                   statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Eligible applications with the account's delinquency milestones, its
    origination limit and the scenario's new limit (one row per application)."""
    apps = _scenario_applications(t, p, target, statuses)
    lines = salted_join(apps, _delinquency_profile(t, p, apps, target))
    if target:
        return target_limit(lines, floor=p.target_limit)
    return what_if_limit(lines, floor=p.target_limit, min_income=p.min_income)


def scenario_projection(t: TableSource, p: Params, *, target: bool = False,
                        statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Scenario lines with peer benchmarks attached and balances projected.

    With ``statuses``, only lines of those bureau statuses are read. The status is
    a benchmark key, so lines of others never touch a kept line.
    """
    lines = scenario_lines(t, p, target=target, statuses=statuses)
    return project_balances(attach_benchmarks(lines, peer_benchmarks(lines)))


def _delinquency_what_if(t: TableSource, p: Params, target: bool,
                         profile: DataFrame | None = None) -> DataFrame:
    """Peer benchmarks, projections and totals as two aggregations over collapsed
    lines (see ``grouped_scenario_totals``); ``scenario_projection`` is the
    row-level form of the same computation."""
    apps = _scenario_applications(t, p, target, HIT_NOHIT if target else ALL_BUREAU)
    lines = collapse(apps, "account_id", "bureau_hit", "score_segment", "risk_label",
                     high_income(p))
    lines = lines.join(_delinquency_profile(t, p, lines, target, profile), "account_id", "inner")
    lines = (target_limit(lines, floor=p.target_limit) if target else
             what_if_limit(lines, floor=p.target_limit, high_income=F.col("high_income")))
    return (delinquency_ratios(grouped_scenario_totals(lines))
            .orderBy("bureau_hit", "risk_label"))


def delinquency_what_if_total(t: TableSource, p: Params = DEFAULT, *,
                              profile: DataFrame | None = None) -> DataFrame:
    """Balance-weighted delinquency at MOB 2, 3 and 9, actual vs the what-if
    where accounts with income >= 4000 and limit < 4000 get a 4000 limit."""
    return _delinquency_what_if(t, p, target=False, profile=profile)


def delinquency_what_if_target(t: TableSource, p: Params = DEFAULT, *,
                               profile: DataFrame | None = None) -> DataFrame:
    """As R4 for accounts with limit < 4000 only, all raised to 4000; peer
    benchmarks come from that restricted population."""
    return _delinquency_what_if(t, p, target=True, profile=profile)


# ---------------------------------------------------------------- R5

def limit_what_if_summary(t: TableSource, p: Params = DEFAULT, *,
                          profile: DataFrame | None = None) -> DataFrame:
    """Current vs new limit (count, mean, min, max) per bureau status."""
    apps = window_applications(t, p, bureau_in=HIT_NOHIT)
    return limit_changes(t, p, apps, "bureau_hit", profile).orderBy("bureau_hit")


def limit_changes(t: TableSource, p: Params, apps: DataFrame, key: str,
                  profile: DataFrame | None = None) -> DataFrame:
    """D8 + D21 over collapsed applications."""
    lines = collapse(apps, "account_id", key, high_income(p))
    lines = what_if_limit(lines.join(account_limits(t, p, lines, profile), "account_id", "inner"),
                          floor=p.target_limit, high_income=F.col("high_income"))
    return limit_summary(lines, key)


# ---------------------------------------------------------------- R6

def _extracted(p: Params) -> list[str]:
    """The printed status, if it is one of the two that these reports read at all."""
    return [s for s in HIT_NOHIT if s == p.extract_status]


def application_volume_pivot(t: TableSource, p: Params = DEFAULT, *,
                             profile: DataFrame | None = None) -> DataFrame:
    """Monthly applications of one bureau status (HIT or NOHIT; no rows for
    another), total and per risk level. (Reads applications only; ``profile`` is
    accepted for a uniform signature.)"""
    apps = eligible_applications(t.applications, org_code=p.org_code, date_from=p.volume_from,
                                 date_to=p.volume_to, bureau_in=_extracted(p),
                                 risk_level_known=True)
    return (pivot_risk_levels(apps, month_trunc("application_date").alias("cohort_month"),
                              p.risk_levels)
            .orderBy("cohort_month"))


# ---------------------------------------------------------------- R7

def risk_mix_by_band(t: TableSource, p: Params = DEFAULT, *,
                     profile: DataFrame | None = None) -> DataFrame:
    """Risk-level mix inside each limit band for one bureau status."""
    apps = window_applications(t, p, bureau_in=_extracted(p))
    lines = banded(t, p, apps.where(F.col("risk_level").isNotNull()), "bureau_hit", "risk_level",
                   profile=profile)
    counts = (lines.groupBy("bureau_hit", "limit_band", "risk_level")
              .agg(F.sum(weight_of(lines)).alias("accounts")))
    mix = share_of_partition(counts, ["bureau_hit", "limit_band"], "accounts",
                             "band_total", "share_of_band")
    return (mix.select("limit_band", "risk_level", "accounts", "band_total", "share_of_band")
            .orderBy("limit_band", "risk_level"))


# ---------------------------------------------------------------- R9

def activation_detail(t: TableSource, p: Params, universe: DataFrame | None = None) -> DataFrame:
    """Per account x opening date: origination limit and the activation flag.

    First the latest first-purchase date per account-month (and limit), then each
    month's date against the opening date. Both aggregations group by account_id
    first, so the fact is hash partitioned by account_id once (stored in buckets, it is
    already) and both, and the joins before them, run without another exchange.
    """
    months = open_months(t, p, p.year_floor, life_to_date=False)
    if getattr(t, "account_buckets", None) is None:
        months = months.repartition("account_id")
    fact = months_on_book(restrict(months, universe, prefilter=_prefilter(t, p)), t.accounts,
                          unique=t.accounts_unique)
    monthly = (fact.groupBy("account_id", "credit_limit", "open_date", "yr", "mo", "mob")
               .agg(F.max("first_purchase_date").alias("first_purchase_date")))
    return (monthly.groupBy("account_id", "open_date")
            .agg(origination_limit().alias("credit_limit"),
                 activation_flag(months=p.activation_months).alias("activated_3m")))


def activation_by_band(t: TableSource, p: Params = DEFAULT, *,
                       profile: DataFrame | None = None) -> DataFrame:
    """Share of accounts with a first purchase within 3 months of opening,
    per limit band, for HIT, NOHIT and both."""
    apps = window_applications(t, p, bureau_in=HIT_NOHIT)
    lines = collapse(apps, "account_id", "bureau_hit", high_income(p))
    detail = (profile.select("account_id", "open_date", "credit_limit", "activated_3m")
              if profile is not None else activation_detail(t, p, universe=lines))
    u = (lines.join(detail, "account_id", "inner")
         .withColumn("limit_band", band_column(p, high_income=F.col("high_income"))))
    n = weight_of(u)
    active = n * F.col("activated_3m")
    of = {s: F.col("bureau_hit") == s.upper() for s in ("hit", "nohit")}
    return (u.groupBy("limit_band").agg(
        *[F.sum(F.when(c, n).otherwise(0)).alias(f"accounts_{s}") for s, c in of.items()],
        *[safe_divide(F.sum(F.when(c, active).otherwise(0)), F.sum(F.when(c, n).otherwise(0)))
          .alias(f"activation_{s}_3m") for s, c in of.items()],
        safe_divide(F.sum(active), F.sum(n)).alias("activation_total"),
    ).orderBy("limit_band"))


REPORTS = {
    "lroi_by_cohort": lroi_by_cohort,
    "limit_band_distribution": limit_band_distribution,
    "avg_limit_trend": avg_limit_trend,
    "delinquency_what_if_total": delinquency_what_if_total,
    "limit_what_if_summary": limit_what_if_summary,
    "application_volume_pivot": application_volume_pivot,
    "risk_mix_by_band": risk_mix_by_band,
    "delinquency_what_if_target": delinquency_what_if_target,
    "activation_by_band": activation_by_band,
}
