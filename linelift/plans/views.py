"""Expose the tables and reports to Spark SQL as temporary views.

The source reports are SQL scripts; users who work in SQL can keep doing so:
after ``register_views`` each input table and each report is a view
(``SELECT * FROM delinquency_what_if_total``). The views are the same lazy
plans the functions build.
"""

from __future__ import annotations

from linelift.plans.params import DEFAULT, Params
from linelift.plans.reports import REPORTS
from linelift.sources.schema import SCHEMAS, TableSource


def register_views(tables: TableSource, p: Params = DEFAULT, names: list[str] | None = None,
                   prefix: str = "") -> list[str]:
    """Create or replace temp views for the four tables and the chosen reports;
    returns the view names."""
    created = []
    for name in SCHEMAS:
        getattr(tables, name).createOrReplaceTempView(prefix + name)
        created.append(prefix + name)
    for name in (list(REPORTS) if names is None else names):
        REPORTS[name](tables, p).createOrReplaceTempView(prefix + name)
        created.append(prefix + name)
    return created
