"""Run reports and write their results (spark-submit friendly).

    python -m linelift --raw /root/testdata/sf0.1 --out /shared/reports
    python -m linelift --stored /shared/portfolio --reports lroi_by_cohort,risk_mix_by_band \\
        --out /shared/reports --format csv
    python -m linelift --raw /root/testdata/sf0.1 --store /shared/portfolio   # build tables only

``--raw`` derives the portfolio tables from the test tables; ``--stored``
reads tables written earlier with ``--store``. Reports run as one batch over a
shared profile unless ``--standalone``. Each result goes to ``<out>/<report>``.
Parameters of ``Params`` can be overridden with ``--param name=value``.
"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from linelift.plans.batch import ReportBatch, run_reports
from linelift.plans.params import DEFAULT, Params
from linelift.plans.reports import REPORTS
from linelift.sources.tpch import load_tables
from linelift.sources.warehouse import read_tables, write_tables


def parse_params(pairs: list[str]) -> Params:
    types = {f.name: f.type for f in dataclasses.fields(Params)}
    kw = {}
    for pair in pairs:
        key, _, value = pair.partition("=")
        if key not in types:
            raise SystemExit(f"unknown parameter {key!r}; known: {sorted(types)}")
        current = getattr(DEFAULT, key)
        if isinstance(current, bool):
            kw[key] = value.lower() in ("1", "true", "yes")
        elif key == "delinquency_levels":  # 2:2,3:3,...
            kw[key] = tuple(tuple(int(x) for x in v.split(":")) for v in value.split(",") if v)
        elif isinstance(current, tuple):
            kind = type(current[0])
            kw[key] = tuple(kind(v) for v in value.split(",") if v)
        elif isinstance(current, int) or "int" in str(types[key]):
            kw[key] = int(value)
        else:
            kw[key] = value
    return DEFAULT.with_(**kw)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="linelift", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--raw", help="folder of the raw test tables (<name>.parquet)")
    src.add_argument("--stored", help="folder of portfolio tables written with --store")
    ap.add_argument("--store", help="write the portfolio tables here (Parquet)")
    ap.add_argument("--out", help="write each report to <out>/<report>")
    ap.add_argument("--reports", default="all", help="comma-separated report names, or all")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--standalone", action="store_true", help="run each report on its own")
    ap.add_argument("--param", action="append", default=[], help="Params override name=value")
    args = ap.parse_args(argv)

    spark = spark or SparkSession.builder.appName("linelift").getOrCreate()
    p = parse_params(args.param)
    tables = load_tables(spark, args.raw) if args.raw else read_tables(spark, args.stored)
    if args.store:
        write_tables(tables, args.store)
        tables = read_tables(spark, args.store)
    names = list(REPORTS) if args.reports == "all" else args.reports.split(",")
    unknown = [n for n in names if n not in REPORTS]
    if unknown:
        raise SystemExit(f"unknown reports {unknown}; known: {list(REPORTS)}")
    if not args.out:
        return {}
    results = (ReportBatch({n: REPORTS[n](tables, p) for n in names}) if args.standalone
               else run_reports(tables, p, names))
    written = {}
    with results:
        for name, df in results.items():
            path = f"{args.out.rstrip('/')}/{name}"
            writer = df.write.mode("overwrite")  # sorted across its files, by file name
            (writer.option("header", True).csv(path) if args.format == "csv"
             else writer.parquet(path))
            written[name] = path
    return written


if __name__ == "__main__":
    main()
