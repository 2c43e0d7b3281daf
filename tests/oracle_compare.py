"""Run a registered Spark query and its DuckDB oracle side by side and compare
column names, types and values (order-insensitive, doubles to 1e-9 relative)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
               "DATE": "date", "BOOLEAN": "boolean"}


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def duck_type(t: str) -> str:
    m = re.fullmatch(r"DECIMAL\((\d+),\s*(\d+)\)", t)
    if m:
        return f"decimal({m.group(1)},{m.group(2)})"
    return _DUCK_TYPES.get(t, t.lower())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return v
    if isinstance(v, dt.datetime):
        return v
    return v


def _key(row):
    return tuple((v is None, "" if v is None else (float(v) if isinstance(v, (float, decimal.Decimal)) else str(v)))
                 for v in row)


def _close(a, b, exact: bool = False) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        return a == b or (not exact and abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b)))
    return a == b


def compare(spark_df, con, sql: str, exact: bool = False) -> list[str]:
    """Return a list of differences (empty when the results agree)."""
    problems = []
    rel = con.sql(sql)
    d_cols, d_types = rel.columns, [duck_type(str(t)) for t in rel.types]
    s_cols = spark_df.columns
    s_types = [f.dataType.simpleString() for f in spark_df.schema.fields]
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns differ: spark={s_cols} duck={d_cols}"]
    dt_by = dict(zip(d_cols, d_types))
    for c, t in zip(s_cols, s_types):
        if dt_by[c] != t:
            problems.append(f"type of {c}: spark={t} duck={dt_by[c]}")
    order = sorted(s_cols)
    s_rows = [tuple(_norm(r[c]) for c in order) for r in spark_df.collect()]
    idx = [d_cols.index(c) for c in order]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
        return problems
    s_rows.sort(key=_key)
    d_rows.sort(key=_key)
    bad = 0
    for a, b in zip(s_rows, d_rows):
        if not all(_close(x, y, exact) for x, y in zip(a, b)):
            bad += 1
            if bad <= 3:
                problems.append(f"row differs:\n  spark={a}\n  duck ={b}\n  cols={order}")
    if bad:
        problems.append(f"{bad} rows differ")
    return problems


def main(argv=None) -> int:
    """python tests/oracle_compare.py [SF_DIR] [--exact] [query ...]

    Every registered query (or the ones named) against its oracle; ``--exact``
    compares doubles bit for bit, as a value hash would."""
    import os
    import sys

    args = list(sys.argv[1:] if argv is None else argv)
    exact = "--exact" in args
    args = [a for a in args if a != "--exact"]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from linelift.session import local_session

    spark = local_session()
    con = duck_connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = args or [n for n in queries if n in oracle]
    bad = 0
    for name in names:
        problems = compare(queries[name](spark, sf_dir), con, oracle[name], exact)
        bad += bool(problems)
        print(("BAD " if problems else "OK  ") + name, *problems[:3], sep="\n    ")
    print(f"{len(names) - bad}/{len(names)} match at {sf_dir}{' (exact)' if exact else ''}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
