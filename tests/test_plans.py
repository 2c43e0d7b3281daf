"""
cartesian product, filters reaching the scans, one aggregate per report over
the monthly fact."""

import re

import pytest

from linelift.plans.catalog import QUERIES
from linelift.plans import reports as R
from linelift.plans.params import DEFAULT


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_cartesian(tables_small, name):
    text = plan_text(QUERIES[name](tables_small, DEFAULT))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                "PythonUDF"):
        assert bad not in text, bad


def test_application_filters_reach_the_scan(tables_small):
    text = plan_text(R.limit_band_distribution(tables_small, DEFAULT))
    assert "PushedFilters: [IsNotNull(o_custkey), IsNotNull(o_orderdate), GreaterThan(o_custkey,0)" in text


@pytest.fixture(scope="module")
def stored(spark, tables_small, tmp_path_factory):
    from linelift.sources.warehouse import read_tables, write_tables

    path = str(tmp_path_factory.mktemp("stored"))
    write_tables(tables_small, path)
    return read_tables(spark, path)


@pytest.fixture
def no_broadcast(spark):
    """Plans as for sides of any size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_r4_has_no_join_on_peer_keys_and_no_sort_aggregate(stored):
    text = plan_text(R.delinquency_what_if_total(stored, DEFAULT))
    assert "SortAggregate" not in text
    join_lines = [ln for ln in text.splitlines() if "Join" in ln]
    assert join_lines and not any("score_segment" in ln for ln in join_lines)
    assert "LeftOuter" in text  # months on book keeps month rows without an account row


PROFILE_REPORTS = ("limit_band_distribution", "avg_limit_trend", "delinquency_what_if_total",
                   "limit_what_if_summary", "risk_mix_by_band", "delinquency_what_if_target",
                   "activation_by_band")


def _depth(text: str, mark: str) -> int:
    """How deep in the tree the first node with ``mark`` stands."""
    line = next(ln for ln in text.splitlines() if mark in ln)
    return len(line) - len(line.lstrip(" :+-*"))


@pytest.mark.parametrize("name", PROFILE_REPORTS)
def test_accounts_restrict_the_fact_before_the_dimension_joins(stored, no_broadcast, name):
    text = plan_text(R.REPORTS[name](stored, DEFAULT))
    assert _depth(text, "LeftSemi") > _depth(text, "LeftOuter")


@pytest.mark.parametrize("name", [*PROFILE_REPORTS, "lroi_by_cohort"])
def test_status_is_pushed_to_every_scan_of_the_applications(stored, no_broadcast, name):
    text = plan_text(R.REPORTS[name](stored, DEFAULT))
    scans = [ln for ln in text.splitlines() if "FileScan" in ln and "application_date" in ln]
    assert len(scans) >= 2
    for scan in scans:
        pushed = scan.split("PushedFilters:")[1]
        assert "bureau_hit" in pushed, scan


def test_r1_scans_lineitem_once(tables_small, no_broadcast):
    df = R.lroi_by_cohort(tables_small, DEFAULT)
    df.collect()
    text = re.split(r"(?m)^\+- == Initial Plan", plan_text(df))[0]
    assert len([ln for ln in text.splitlines() if "FileScan" in ln and "l_orderkey" in ln]) == 1
    assert "shuffle_hash" not in text and "ShuffledHashJoin" not in text


def test_shares_need_no_single_task(stored, no_broadcast):
    text = plan_text(R.limit_band_distribution(stored, DEFAULT))
    assert "Window" not in text


def _rows_into_joins(df) -> int:
    """The most rows of one account that enters a join with the per-account side."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    most = 0

    def walk(n):
        nonlocal most
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(n.executedPlan())
        if "QueryStage" in name:
            return walk(n.plan())
        children = n.children()
        for i in range(children.size()):
            child = children.apply(i)
            if "Join" in name:
                most = max(most, _first_count(child))
            walk(child)

    def _first_count(n):
        while True:
            if "QueryStage" in n.nodeName():
                n = n.plan()
                continue
            if n.nodeName() == "AdaptiveSparkPlan":
                n = n.executedPlan()
                continue
            rows = n.metrics().get("numOutputRows")
            if rows.isDefined():
                return rows.get().value()
            if n.children().size() != 1:
                return 0
            n = n.children().apply(0)

    walk(node)
    return most


@pytest.mark.parametrize("name", PROFILE_REPORTS)
def test_a_hot_account_meets_the_joins_collapsed(spark, no_broadcast, name):
    """One account with 20,000 applications enters every join as a few rows."""
    from fixtures import app, month, tables
    from pyspark.sql import functions as F

    few = tables(spark, [app(i, date="1995-04-01", hit="NOHIT") for i in range(1, 6)],
                 [(i, "1995-01-15") for i in range(1, 6)],
                 [month(i, 1995, m, limit=1000 * i, balance=10) for i in range(1, 6) for m in range(1, 12)])
    hot = (spark.range(20_000).select(F.lit(1).alias("account_id"), (F.col("id") % 2).alias("odd"))
           .join(few.applications.where("account_id = 1").drop("account_id")))
    hot = hot.withColumn("bureau_hit", F.when(F.col("odd") == 1, "HIT").otherwise("NOHIT")).drop("odd")
    from linelift.sources.schema import SCHEMAS, Tables, conform

    apps = few.applications.unionByName(conform(
        hot.withColumn("account_id", F.col("account_id").cast("long")), SCHEMAS["applications"]))
    t = Tables(apps, few.accounts, few.account_month, few.profit_month)
    assert _rows_into_joins(R.REPORTS[name](t, DEFAULT)) < 100


def test_salted_join_deals_a_hot_key_and_keeps_every_row(spark, no_broadcast):
    from linelift.operators.skew import salted_join
    from pyspark.sql import functions as F

    left = (spark.range(5000).select(F.lit(7).cast("long").alias("account_id"), "id")
            .union(spark.range(100).select(F.col("id").alias("account_id"), "id")))
    right = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (500, 4)], "account_id long, v long")
    got = salted_join(left, right, share=4, salts=8)
    want = left.join(right, "account_id")
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert "_salt" in plan_text(got)


# ---------------------------------------------------------------- pruning before the shuffles

RECENT = ("limit_band_distribution", "avg_limit_trend", "delinquency_what_if_total", "limit_what_if_summary",
          "risk_mix_by_band", "delinquency_what_if_target", "activation_by_band")


def _lineitem_filters(df):
    lines = plan_text(df).splitlines()
    return [ln.split("PushedFilters:")[1] for ln in lines if "FileScan" in ln and "l_orderkey" in ln]


@pytest.mark.parametrize("name", RECENT)
def test_year_floor_reaches_the_raw_scan_as_a_date_range(tables_small, name):
    pushed = _lineitem_filters(R.REPORTS[name](tables_small, DEFAULT))
    assert pushed and all("GreaterThanOrEqual(l_shipdate,1995-01-01T00:00" in p for p in pushed)


def test_running_sums_read_the_whole_history(tables_small):
    assert not any("GreaterThan" in p and "l_shipdate" in p
                   for p in _lineitem_filters(R.lroi_by_cohort(tables_small, DEFAULT)))


def test_months_are_aggregated_by_hash(tables_small):
    for name, report in R.REPORTS.items():
        text = plan_text(report(tables_small, DEFAULT))
        assert not [ln for ln in text.splitlines() if "SortAggregate" in ln and "l_extendedprice" in ln], name


def test_statuses_keep_their_order_and_length(spark):
    """The smallest status of a month, whatever the strings are."""
    from linelift.sources.tpch import RAW_SCHEMAS, customer_month
    import datetime as dt

    statuses = ["F", "Open for long", "", "ab", "a", None, "é", "Z" * 40]
    day = dt.datetime(1995, 3, 4)
    orders = [(i, 1 if i < 4 else 2 if i < 6 else 3, s, 1.0, day, "1-X") for i, s in enumerate(statuses)]
    fields = {f.name for f in RAW_SCHEMAS["orders"].fields}
    assert {"o_orderkey", "o_custkey", "o_orderstatus"} <= fields
    frame = spark.createDataFrame([(o[0], o[1], o[2]) for o in orders],
                                  "o_orderkey long, o_custkey long, o_orderstatus string")
    items = spark.createDataFrame([(i, 1, 1.0, 10.0, 0.0, 0.0, "N", "F", day) for i in range(len(statuses))],
                                  RAW_SCHEMAS["lineitem"])
    got = customer_month({"lineitem": items, "orders": frame}).select("account_id", "status_code").collect()
    assert {r[0]: r[1] for r in got} == {1: "", 2: "a", 3: "Z" * 40}


def _shuffled_bytes(df) -> int:
    """Bytes written to all exchanges of the plan that ran."""
    df.collect()
    total, seen = 0, set()

    def walk(n):
        nonlocal total
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(n.executedPlan())
        if "QueryStage" in name:
            return walk(n.plan())
        if name == "Exchange" and n.id() not in seen:
            seen.add(n.id())
            size = n.metrics().get("dataSize")
            total += size.get().value() if size.isDefined() else 0
        children = n.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_prefilter_spares_the_shuffle_of_foreign_accounts(spark, tables_small, no_broadcast, tmp_path):
    """Shuffled bytes of R8 fall with the share of accounts kept; the result stays."""
    from linelift.sources.schema import SCHEMAS, Tables, conform

    frames = {}
    for name, df in tables_small.as_dict().items():  # plain files: no buckets, nothing derived
        df.write.parquet(str(tmp_path / name))
        frames[name] = conform(spark.read.parquet(str(tmp_path / name)), SCHEMAS[name], name)
    t = Tables(**frames)
    assert t.accounts_unique
    spared = []
    for end in ("1995-01-31", "1998-12-31"):
        p = DEFAULT.with_(target_to=end)
        plain, filtered = (R.delinquency_what_if_target(t, p.with_(prefilter_accounts=f)) for f in (False, True))
        before, after = _shuffled_bytes(plain), _shuffled_bytes(filtered)
        assert plain.collect() == filtered.collect()
        spared.append(1 - after / before)
    assert spared[0] > 0.5 and spared[0] > spared[1], spared


def test_hot_keys_are_all_found_and_few(spark):
    from linelift.operators.skew import hot_keys
    from pyspark.sql import functions as F

    for share in (4, 64, 1024):
        # keys of all sizes around the share, some of one row, nulls
        rows = (spark.range(300_000).select(F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
            F.floor(F.pow(F.rand(5), 6.0) * 20_000)).cast("long").alias("k")).cache())
        n = rows.count()
        counts = {r[0]: r[1] for r in rows.where("k is not null").groupBy("k").count().collect()}
        found = [r[0] for r in hot_keys(rows, "k", share).collect()]
        assert len(set(found)) == len(found) <= 2 * share
        assert {k for k, c in counts.items() if c * share > n} <= set(found)
        assert all(counts[k] * share * 2 > n for k in found)
    assert hot_keys(rows.limit(0), "k").collect() == []


def test_salted_join_scans_the_applications_twice(spark, tables_small, no_broadcast):
    """Once for the summary of hot accounts and once for the join."""
    from linelift.operators.skew import salted_join

    apps = tables_small.applications.select("account_id", "income")
    text = plan_text(salted_join(apps, tables_small.accounts))
    assert "approx_top_k" in text
    hot = [ln for ln in text.splitlines() if "Exchange hashpartitioning(account_id" in ln]
    assert not any("_n" in ln for ln in hot)
