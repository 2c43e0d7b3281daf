"""Run several reports over one shared per-account profile.

Alone, each report makes its own pass over the monthly fact: filter, join the
account dimension, aggregate per account. Eight of the nine reports make the
same pass (same filters, same grouping key) and differ only in the aggregate
columns they keep. Run as a batch, the fact is aggregated once per
(account_id, open_date) with every column any report reads, for the accounts that
the chosen reports can keep. The profile is written as Parquet under the
session's shared ``spark.checkpoint.dir``, which also cuts lineage: a lost
executor never re-runs the fact pass. Each report then reads the profile;
``ReportBatch.close`` deletes it.

The profile needs monthly rows unique per (account_id, yr, mo): then the activation
report's per-month pre-aggregation is the identity.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from linelift.operators.facts import ALL_BUREAU, HIT_NOHIT, eligible_applications, net_placement
from linelift.operators.profiles import (activation_flag, milestone_delinquency,
                                         milestone_values, origination_limit)
from linelift.plans import reports as R
from linelift.plans.params import DEFAULT, Params
from linelift.sources.schema import TableSource
from linelift.sources.warehouse import (default_buckets, delete_folder, open_bucketed, shared_path,
                                        write_bucketed)

# The windows whose accounts a report keeps: (from, to, bureau statuses) by parameter name.
_WINDOW = ("window_from", "window_to")
_UNIVERSES = {
    "lroi_by_cohort": (("roi_from", None), ALL_BUREAU),
    "limit_band_distribution": (_WINDOW, HIT_NOHIT),
    "avg_limit_trend": (("trend_after", None), HIT_NOHIT),
    "delinquency_what_if_total": (_WINDOW, ALL_BUREAU),
    "limit_what_if_summary": (_WINDOW, HIT_NOHIT),
    "risk_mix_by_band": (_WINDOW, HIT_NOHIT),
    "delinquency_what_if_target": (("target_from", "target_to"), HIT_NOHIT),
    "activation_by_band": (_WINDOW, HIT_NOHIT),
}


# Reports whose limit is the account's, over all its opening dates.
_BY_ACCOUNT = ("limit_band_distribution", "risk_mix_by_band")


def readers(names: list[str], p: Params = DEFAULT, accounts_unique: bool = True) -> list[str]:
    """The chosen reports that read the shared profile: not the one that reads no
    monthly fact, nor those with a year floor or, if accounts have several rows, a grain of
    their own."""
    other = {"lroi_by_cohort": p.roi_year_floor, "delinquency_what_if_target": p.r8_year_floor}
    return [n for n in names if n in _UNIVERSES and other.get(n, p.year_floor) == p.year_floor
            and (accounts_unique or n not in _BY_ACCOUNT)]


def profile_universe(t: TableSource, p: Params, names: list[str]) -> DataFrame:
    """The accounts that any of the reports can keep."""
    kept = None
    for (start, end), statuses in {_UNIVERSES[n] for n in names}:
        apps = eligible_applications(t.applications, org_code=p.org_code,
                                     date_from=getattr(p, start),
                                     date_to=end and getattr(p, end), bureau_in=statuses)
        apps = apps.select("account_id")
        kept = apps if kept is None else kept.union(apps)
    return kept


def shared_profile(t: TableSource, p: Params = DEFAULT,
                   universe: DataFrame | None = None) -> DataFrame:
    """One row per (account_id, open_date): origination limit, delinquency
    milestones, placement milestones and the activation flag."""
    fact = R.month_fact(t, p, universe=universe).withColumn("placed", net_placement())
    return fact.groupBy("account_id", "open_date").agg(
        origination_limit().alias("credit_limit"),
        *milestone_delinquency(dict(p.delinquency_levels)),
        *milestone_values("placed", p.horizons, prefix="placed"),
        activation_flag(months=p.activation_months).alias("activated_3m"),
    )


class ReportBatch(dict):
    """Report name -> DataFrame. ``close`` (or leaving a ``with`` block) deletes the
    stored profile; the reports cannot be read any more then."""

    def __init__(self, reports: dict[str, DataFrame], profile_path: str | None = None,
                 profile_table: str | None = None):
        super().__init__(reports)
        self.profile_path, self.profile_table = profile_path, profile_table

    def close(self) -> None:
        if self.profile_path and self:
            spark = next(iter(self.values())).sparkSession
            spark.sql(f"DROP TABLE IF EXISTS {self.profile_table}")
            delete_folder(spark, self.profile_path)
        self.profile_path = None

    def __enter__(self) -> "ReportBatch":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def materialise_profile(t: TableSource, p: Params = DEFAULT, path: str | None = None,
                        universe: DataFrame | None = None) -> tuple[DataFrame, str, str]:
    """Write the shared profile, bucketed by account, to ``path`` (default: a new folder
    under the shared checkpoint directory); it read back from there, the path, and the name of
    the catalog's table. The reports join collapsed applications to its buckets, so the
    profile is not shuffled again by any of them."""
    profile = shared_profile(t, p, universe)
    spark = profile.sparkSession
    name = f"linelift_profile_{uuid.uuid4().hex}"
    path = path or shared_path(spark, name)
    buckets = getattr(t, "account_buckets", None) or default_buckets(spark)
    write_bucketed(profile, path, buckets)
    return open_bucketed(spark, path, profile.schema, buckets, name), path, name


def run_reports(t: TableSource, p: Params = DEFAULT, names: list[str] | None = None,
                profile_path: str | None = None) -> ReportBatch:
    """The chosen reports (default: all nine), over one materialised profile if at least
    one of them reads it.

    The profile is written eagerly (one job over the monthly fact); the
    returned DataFrames are lazy and read it.
    """
    names = list(R.REPORTS) if names is None else names
    shared = readers(names, p, t.accounts_unique)
    if not shared:
        return ReportBatch({n: R.REPORTS[n](t, p) for n in names})
    profile, path, table = materialise_profile(t, p, profile_path, profile_universe(t, p, shared))
    return ReportBatch({n: R.REPORTS[n](t, p, profile=profile if n in shared else None)
                        for n in names}, path, table)
