"""Credit-line portfolio analytics on Spark (see README.md)."""

from linelift.plans.params import DEFAULT, Params
from linelift.sources.schema import TableSource, Tables

__all__ = ["DEFAULT", "Params", "TableSource", "Tables"]
