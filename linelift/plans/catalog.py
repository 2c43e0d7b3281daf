"""Every query the package registers: the nine reports, two of them again with other
``(TableSource, Params) -> DataFrame``.

The operator queries run the operator with the reports' default parameters, so
each one is checked on its own. Those of row-level helpers and summaries (months on
book, net placement, counts and shares) read their whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelift.functions.columns import clean_label, month_trunc, period_label
from linelift.operators import facts, profiles, scenario, skew, summaries
from linelift.plans import profile_state
from linelift.plans import reports as R
from linelift.plans.params import DEFAULT, Params
from linelift.sources.schema import TableSource


def q_months_on_book(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return facts.months_on_book(t.account_month, t.accounts, unique=t.accounts_unique).select(
        "account_id", "yr", "mo", "open_date", "mob")


def q_origination_limit(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return profiles.account_profile(R.month_fact(t, p), ("account_id", "open_date"))


def q_milestone_values(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    fact = R.month_fact(t, p, "inner").withColumn("placed", facts.net_placement())
    return fact.groupBy("account_id").agg(
        *profiles.milestone_values("placed", p.horizons, prefix="placed"))


def q_milestone_delinquency(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return (R.month_fact(t, p).groupBy("account_id", "open_date")
            .agg(*profiles.milestone_delinquency(dict(p.delinquency_levels))))


def q_open_period(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return t.accounts.select("account_id", "open_date",
                             period_label("open_date").alias("open_period"))


def q_clean_risk_label(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return (t.applications
            .groupBy(F.col("risk_label").alias("raw_label"),
                     clean_label("risk_label").alias("risk_label"))
            .agg(F.count(F.lit(1)).alias("applications")))


def q_eligible_applications(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return R.window_applications(t, p)


def q_open_account_months(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return facts.open_account_months(t.account_month, info_type=p.info_type,
                                     year_floor=p.year_floor, excluded_statuses=p.closed_statuses)


def _limit_lines(t: TableSource, p: Params) -> DataFrame:
    apps = R.window_applications(t, p).select("account_id", "application_date", "bureau_hit",
                                              "income")
    return skew.salted_join(apps, R.account_limits(t, p, apps).drop("open_date"))


def q_what_if_limit(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return scenario.what_if_limit(_limit_lines(t, p), floor=p.target_limit,
                                  min_income=p.min_income)


def q_what_if_limit_target(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return scenario.target_limit(_limit_lines(t, p), floor=p.target_limit)


def q_limit_band(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return (R.banded_universe(t, p, R.window_applications(t, p))
            .select("account_id", "application_date", "bureau_hit", "income", "credit_limit",
                    "limit_band"))


def q_activation_flag(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return R.activation_detail(t, p)


def q_peer_benchmarks(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return scenario.peer_benchmarks(R.scenario_lines(t, p))


def q_project_balances(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    proj = R.scenario_projection(t, p)
    new_cols = [c for c in proj.columns if c.endswith("m_new")]
    return proj.select("account_id", "bureau_hit", "score_segment", "risk_label", "credit_limit",
                       "new_limit", *new_cols)


def _totals(t: TableSource, p: Params, keys) -> DataFrame:
    proj = R.scenario_projection(t, p, statuses=facts.ALL_BUREAU)
    return scenario.scenario_totals(proj, keys)


def q_scenario_totals(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return _totals(t, p, ("bureau_hit", "risk_label"))


def q_delinquency_ratios(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    keys = ("bureau_hit",)
    return scenario.delinquency_ratios(_totals(t, p, keys), keys)


def q_share_of_total(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    counts = t.applications.groupBy("score_segment").agg(F.count(F.lit(1)).alias("applications"))
    return summaries.share_of_total(counts, ["applications"], ["share_applications"])


def q_share_of_partition(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    counts = (t.applications.groupBy("bureau_hit", "score_segment")
              .agg(F.count(F.lit(1)).alias("applications")))
    return summaries.share_of_partition(counts, ["bureau_hit"], "applications",
                                        "status_total", "share_of_status")


def q_count_by_status(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return summaries.count_by_status(t.applications, "score_segment", statuses=facts.ALL_BUREAU)


def q_pivot_risk_levels(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    apps = facts.eligible_applications(t.applications, org_code=p.org_code,
                                       date_from=p.volume_from, date_to=p.volume_to,
                                       risk_level_known=True)
    return summaries.pivot_risk_levels(apps, month_trunc("application_date").alias("cohort_month"),
                                       p.risk_levels)


def q_net_placement(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return t.account_month.select("account_id", "yr", "mo",
                                  facts.net_placement().alias("net_placement"))


def q_profit_milestones(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return profiles.profit_milestones(t.profit_month, t.accounts, R.roi_universe(t, p),
                                      year_floor=p.roi_year_floor, months=p.horizons,
                                      unique=t.accounts_unique)


def q_limit_summary(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return R.limit_changes(t, p, R.window_applications(t, p), "score_segment")


def q_distinct_universe(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return R.roi_universe(t, p)


def q_roi_by_horizon(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    return summaries.roi_by_horizon(R.roi_accounts(t, p), ["open_period"], p.horizons)


def q_lroi_earlier_floor(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    """R1 reading a year of months that the other reports don't (their floor is later)."""
    return R.lroi_by_cohort(t, p.with_(**EARLIER_FLOOR))


def q_delinquency_target_later_balances(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    """R8 with applications from two months before its first balances on."""
    return R.delinquency_what_if_target(t, p.with_(**LATER_BALANCES))


def _reopened(report):
    """A report over accounts that opened several times (S7): the limit of an application comes
    from each opening, or from all of them together, and balances are joined back per pair."""
    def query(t: TableSource, p: Params = DEFAULT) -> DataFrame:
        return report(t.reopened, p)

    return query


def q_delinquency_target_prefiltered(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    """R8 with a Bloom filter over its accounts before the monthly fact is shuffled (JN2)."""
    return R.delinquency_what_if_target(t, p.with_(prefilter_accounts=True))


def q_profile_in_steps(t: TableSource, p: Params = DEFAULT) -> DataFrame:
    """The account profile folded from one state per year of months."""
    return profile_state.folded_by_year(t, p)


EARLIER_FLOOR = {"year_floor": 1996, "roi_year_floor": 1995}
LATER_BALANCES = {"target_from": "1995-11-01", "target_to": "1996-12-31", "target_year_floor": 1996}

OPERATORS = {
    "months_on_book": q_months_on_book,                  # D1
    "origination_limit": q_origination_limit,            # D2
    "milestone_values": q_milestone_values,              # D3a
    "milestone_delinquency": q_milestone_delinquency,    # D3b
    "open_period": q_open_period,                        # D4
    "clean_risk_label": q_clean_risk_label,              # D5
    "eligible_applications": q_eligible_applications,    # D6
    "open_account_months": q_open_account_months,        # D7
    "what_if_limit": q_what_if_limit,                    # D8
    "what_if_limit_target": q_what_if_limit_target,      # D8, target variant
    "limit_band": q_limit_band,                          # D9
    "activation_flag": q_activation_flag,                # D10
    "peer_benchmarks": q_peer_benchmarks,                # D11
    "project_balances": q_project_balances,              # D12
    "scenario_totals": q_scenario_totals,                # D13
    "delinquency_ratios": q_delinquency_ratios,          # D14
    "share_of_total": q_share_of_total,                  # D15
    "share_of_partition": q_share_of_partition,          # D16
    "count_by_status": q_count_by_status,                # D17
    "pivot_risk_levels": q_pivot_risk_levels,            # D18
    "net_placement": q_net_placement,                    # D19
    "profit_milestones": q_profit_milestones,            # D20
    "limit_summary": q_limit_summary,                    # D21
    "distinct_universe": q_distinct_universe,            # D22
    "roi_by_horizon": q_roi_by_horizon,                  # D23
    "lroi_by_cohort_earlier_floor": q_lroi_earlier_floor,                              # R1, FLT7
    "delinquency_what_if_target_later_balances": q_delinquency_target_later_balances,  # R8, S16
    "delinquency_what_if_total_reopened": _reopened(R.delinquency_what_if_total),      # R4, JN5, S7
    "delinquency_what_if_target_reopened": _reopened(R.delinquency_what_if_target),    # R8, JN5, S7
    "limit_band_distribution_reopened": _reopened(R.limit_band_distribution),          # R2, D2, S7
    "lroi_by_cohort_reopened": _reopened(R.lroi_by_cohort),                            # R1, S7
    "delinquency_what_if_target_prefiltered": q_delinquency_target_prefiltered,        # R8, JN2
    "profile_in_steps": q_profile_in_steps,                                            # D2, D3a, D3b, D10
    "activation_by_band_reopened": _reopened(R.activation_by_band),                    # R9, S7
}

QUERIES = {**R.REPORTS, **OPERATORS}
