"""Stored tables: round trip, partition pruning, co-located buckets, replaceable versions."""

import os
import uuid

import pytest

from linelift.plans import reports as R
from linelift.plans.batch import run_reports
from linelift.plans.params import DEFAULT
from linelift.sources import warehouse
from linelift.sources.warehouse import (open_bucketed, read_tables, shared_path, vacuum_tables, versions,
                                        write_bucketed, write_tables)
from oracle_compare import _close


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def path(spark, tables_small):
    path = shared_path(spark, f"warehouse-{uuid.uuid4().hex}")
    write_tables(tables_small, path)
    return path


def test_round_trip_and_partition_pruning(spark, tables_small, path):
    stored = read_tables(spark, path)
    for name, df in stored.as_dict().items():
        assert df.dtypes == getattr(tables_small, name).dtypes
        assert df.exceptAll(getattr(tables_small, name)).isEmpty()
        assert df.count() == getattr(tables_small, name).count()
    # same report from stored and derived tables
    a = R.delinquency_what_if_total(stored, DEFAULT).collect()  # both sorted by the report
    b = R.delinquency_what_if_total(tables_small, DEFAULT).collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(_close(u, v) for u, v in zip(x, y))
    plan = plan_text(R.avg_limit_trend(stored, DEFAULT))
    assert "PartitionFilters: [isnotnull(yr" in plan and "(yr#" in plan and ">= 1995" in plan


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def above(text: str, mark: str) -> list[list[str]]:
    """For each line with ``mark``, the lines of the nodes above it in the tree."""
    out, stack = [], []
    for line in text.splitlines():
        node = line.lstrip(" :+-*")
        if not node:
            continue
        depth = len(line) - len(node)
        stack = [(d, n) for d, n in stack if d < depth]
        if mark in node:
            out.append([n for _, n in stack])
        stack.append((depth, node))
    return out


@pytest.mark.parametrize("name", ["limit_band_distribution", "avg_limit_trend", "delinquency_what_if_total",
                                  "delinquency_what_if_target", "activation_by_band"])
def test_facts_and_dimension_are_not_shuffled(spark, path, no_broadcast, name):
    """No exchange between a bucketed scan and the join of the per-account aggregate; what
    meets it (collapsed applications, their accounts) is dealt to the buckets."""
    text = plan_text(R.REPORTS[name](read_tables(spark, path), DEFAULT))
    scans = above(text, "linelift_v")
    assert len(scans) >= 2
    for nodes in scans:
        inner = max(i for i, n in enumerate(nodes) if "Join" in n and "Inner" in n)
        assert any("HashAggregate" in n for n in nodes[inner:])
        assert not [n for n in nodes[inner:] if "Exchange" in n], nodes


def test_profile_is_not_shuffled_by_the_batch(spark, path, no_broadcast):
    with run_reports(read_tables(spark, path), DEFAULT, ["limit_band_distribution", "limit_what_if_summary"]) as batch:
        for df in batch.values():
            for nodes in above(plan_text(df), "linelift_profile"):
                inner = max(i for i, n in enumerate(nodes) if "Join" in n and "Inner" in n)
                assert not [n for n in nodes[inner:] if "Exchange" in n], nodes


def test_one_file_per_bucket_and_year(spark, path, tables_small):
    stored = read_tables(spark, path)
    years = tables_small.account_month.select("yr").distinct().count()
    files = stored.account_month.inputFiles()
    assert len(files) <= years * stored.account_buckets
    keys = spark.read.parquet(f"{path}/{stored.version}/accounts")
    assert keys.inputFiles() and keys.count() == tables_small.accounts.count()


def test_buckets_of_any_number_give_the_same_reports(spark, path, tables_small, tmp_path):
    want = R.limit_band_distribution(tables_small, DEFAULT).collect()
    for buckets in (1, 3, 16):
        write_tables(tables_small, str(tmp_path / str(buckets)), buckets=buckets)
        stored = read_tables(spark, str(tmp_path / str(buckets)))
        assert stored.account_buckets == buckets
        got = R.limit_band_distribution(stored, DEFAULT).collect()
        assert all(_close(u, v) for x, y in zip(got, want) for u, v in zip(x, y)) and len(got) == len(want)


def test_a_failed_write_leaves_the_old_version(spark, tables_small, tmp_path, monkeypatch):
    path = str(tmp_path / "tables")
    with pytest.raises(FileNotFoundError):
        read_tables(spark, path)
    first = write_tables(tables_small, path)
    counts = {n: df.count() for n, df in read_tables(spark, path).as_dict().items()}

    written = []

    def killed(df, target, *rest):
        if written:
            raise KeyboardInterrupt
        written.append(target)
        write_bucketed(df, target, *rest)

    monkeypatch.setattr(warehouse, "write_bucketed", killed)
    with pytest.raises(KeyboardInterrupt):
        write_tables(tables_small, path)
    monkeypatch.undo()
    assert written and os.path.isdir(written[0])  # half of it is there, and nobody sees it
    stored = read_tables(spark, path)
    assert stored.version == first
    assert {n: df.count() for n, df in stored.as_dict().items()} == counts


def test_versions_and_vacuum(spark, tables_small, tmp_path):
    path = str(tmp_path / "tables")
    first, second = write_tables(tables_small, path), write_tables(tables_small, path)
    old = read_tables(spark, path, first)
    assert read_tables(spark, path).version == second and old.accounts.count() > 0
    with pytest.raises(FileExistsError):
        write_tables(tables_small, path, mode="error")
    with pytest.raises(FileNotFoundError):
        read_tables(spark, path, "v0")
    assert vacuum_tables(spark, path) == [first]
    assert not os.path.exists(f"{path}/{first}") and read_tables(spark, path).accounts.count() > 0
    assert [v for _, v, *_ in versions(spark, path)] == [first, second]


def test_close_leaves_no_tables_behind(spark, path):
    stored = read_tables(spark, path)
    assert stored.account_month.count() > 0
    stored.close()
    assert not [r for r in spark.sql("show tables").collect() if stored.version in r.tableName]
    assert read_tables(spark, path).account_month.count() > 0


def test_bucketed_files_with_null_and_negative_keys(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (-5, 2), (7, 3), (7, 4)], "account_id long, v int")
    write_bucketed(df, str(tmp_path / "t"), 3)
    got = open_bucketed(spark, str(tmp_path / "t"), df.schema, 3, f"linelift_t_{uuid.uuid4().hex}")
    assert got.exceptAll(df).isEmpty() and got.count() == 4
