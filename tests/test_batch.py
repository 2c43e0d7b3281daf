"""The batch (one shared profile) gives the same reports as running each alone."""


from linelift.plans import reports as R
from linelift.plans.batch import run_reports
from linelift.plans.params import DEFAULT
from oracle_compare import _close


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(_close(u, v) for u, v in zip(x, y)), (x, y)


def test_batch_equals_standalone(spark, tables_small):
    batch = run_reports(tables_small, DEFAULT)
    assert set(batch) == set(R.REPORTS)
    for name, df in batch.items():
        _same(df.collect(), R.REPORTS[name](tables_small, DEFAULT).collect())


def test_batch_on_random_tables(spark):
    from test_randomized import generate
    from linelift.sources.schema import SCHEMAS, Tables
    for seed in (7, 99):
        t = Tables(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in generate(seed).items()})
        for name, df in run_reports(t, DEFAULT).items():
            _same(df.collect(), R.REPORTS[name](t, DEFAULT).collect())


def test_r8_with_other_year_floor_ignores_shared_profile(spark, tables_small):
    p = DEFAULT.with_(target_year_floor=1996)
    batch = run_reports(tables_small, p, ["delinquency_what_if_target"])
    _same(batch["delinquency_what_if_target"].collect(),
          R.delinquency_what_if_target(tables_small, p).collect())


def test_profile_only_if_a_report_reads_it(spark, tables_small, monkeypatch):
    from linelift.plans import batch

    def no_profile(*_):
        raise AssertionError("the profile was built")

    monkeypatch.setattr(batch, "materialise_profile", no_profile)
    alone = run_reports(tables_small, DEFAULT, ["application_volume_pivot"])
    _same(alone["application_volume_pivot"].collect(),
          R.application_volume_pivot(tables_small, DEFAULT).collect())
    other = DEFAULT.with_(target_year_floor=1996)
    assert list(run_reports(tables_small, other, ["delinquency_what_if_target"])) == [
        "delinquency_what_if_target"]


def test_nothing_is_left_behind(spark, tables_small, tmp_path):
    import os

    before = {r.tableName for r in spark.sql("show tables").collect()}
    with run_reports(tables_small, DEFAULT, ["limit_what_if_summary"],
                     profile_path=str(tmp_path / "profile")) as batch:
        assert batch["limit_what_if_summary"].count() == 2
        assert os.path.isdir(tmp_path / "profile")
    assert not os.path.exists(tmp_path / "profile")
    assert {r.tableName for r in spark.sql("show tables").collect()} == before


def test_profile_holds_the_accounts_of_the_chosen_reports(spark, tables_small):
    from linelift.plans.batch import profile_universe, shared_profile

    names = ["limit_what_if_summary"]
    small = shared_profile(tables_small, DEFAULT, profile_universe(tables_small, DEFAULT, names))
    apps = R.window_applications(tables_small, DEFAULT, bureau_in=["HIT", "NOHIT"])
    assert small.join(apps, "account_id", "left_anti").count() == 0
    assert small.count() < shared_profile(tables_small, DEFAULT).count()
