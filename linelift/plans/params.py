"""Report parameters: every literal of the source scripts, with defaults set for
the test tables (FIXTURES.md section 2)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from linelift.functions.bands import BAND_EDGES, BAND_LABELS, TARGET_LIMIT, TARGET_MIN_INCOME
from linelift.operators.facts import CLOSED_STATUSES
from linelift.operators.profiles import DELINQUENCY_MILESTONES, VALUE_MILESTONES
from linelift.operators.summaries import RISK_LEVELS
from linelift.sources.tpch import PRODUCT_CODE


@dataclass(frozen=True)
class Params:
    org_code: int = PRODUCT_CODE           # product of the applications
    info_type: int = PRODUCT_CODE          # product of the monthly rows
    year_floor: int = 1995                 # first year of monthly rows read
    closed_statuses: tuple[str, ...] = CLOSED_STATUSES
    # application windows (inclusive unless noted)
    window_from: str = "1995-03-01"        # limit bands, risk mix, activation, R4, R5
    window_to: str = "1995-08-31"
    roi_from: str = "1995-01-01"           # R1, open-ended
    roi_year_floor: int = 1994             # R1: it reads a year more than the others
    trend_after: str = "1995-01-01"        # R3, strictly after
    volume_from: str = "1995-01-01"        # R6
    volume_to: str = "1997-05-31"
    target_from: str = "1994-11-01"        # R8: starts two months before the balances
    target_to: str = "1995-12-31"
    target_year_floor: int | None = None   # R8 monthly floor; None = year_floor
    target_limit: int = TARGET_LIMIT
    min_income: int = TARGET_MIN_INCOME
    extract_status: str = "NOHIT"          # the status R6 and R7 print
    activation_months: int = 3
    band_edges: tuple[int, ...] = BAND_EDGES
    band_labels: tuple[str, ...] = BAND_LABELS
    delinquency_levels: tuple[tuple[int, int], ...] = tuple(DELINQUENCY_MILESTONES.items())
    horizons: tuple[int, ...] = VALUE_MILESTONES
    risk_levels: tuple[int, ...] = RISK_LEVELS
    dedupe_applications: bool = False      # keep an account's latest application only
    prefilter_accounts: bool = False       # Bloom filter before the monthly facts are shuffled

    def __post_init__(self) -> None:
        dates = {f: getattr(self, f) for f in ("window_from", "window_to", "roi_from", "trend_after",
                                                "volume_from", "volume_to", "target_from", "target_to")}
        parsed = {}
        for name, value in dates.items():
            try:
                parsed[name] = dt.date.fromisoformat(value)
            except (TypeError, ValueError) as e:
                raise ValueError(f"Params.{name} must be an ISO date, got {value!r}") from e
        for lo, hi in (("window_from", "window_to"), ("volume_from", "volume_to"),
                       ("target_from", "target_to")):
            if parsed[lo] > parsed[hi]:
                raise ValueError(f"Params.{lo} ({parsed[lo]}) is after {hi} ({parsed[hi]})")
        if len(self.band_labels) != len(self.band_edges) + 3:
            raise ValueError(f"Params.band_labels: need {len(self.band_edges) + 3} labels for "
                             f"{len(self.band_edges)} edges")
        if list(self.band_edges) != sorted(set(self.band_edges)):
            raise ValueError("Params.band_edges must ascend")
        if [m for m, _ in self.delinquency_levels] != list(DELINQUENCY_MILESTONES):
            raise ValueError(f"Params.delinquency_levels: months are {list(DELINQUENCY_MILESTONES)}")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def r8_year_floor(self) -> int:
        return self.year_floor if self.target_year_floor is None else self.target_year_floor


DEFAULT = Params()
