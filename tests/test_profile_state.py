"""States of any split of the months, late and repeated ones included, merge to the full profile."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from linelift.plans.batch import shared_profile
from linelift.plans.params import DEFAULT
from linelift.plans.profile_state import (finish, folded_by_year, merge_states, profile_state, read_state,
                                          write_state)
from linelift.sources.schema import SCHEMAS, Tables


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    a = a.select(b.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_splits_with_late_and_repeated_months(spark, seed):
    from test_randomized import generate

    t = Tables(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in generate(seed).items()})
    full = shared_profile(t, DEFAULT)
    rng = random.Random(seed)
    months = t.account_month.collect()
    parts = [[] for _ in range(4)]
    for m in months:
        for part in rng.sample(parts, rng.choice([1, 1, 2])):  # some months come twice
            part.append(m)
    rng.shuffle(parts)
    state = None
    for part in parts:  # each is folded in without the ones before
        new = profile_state(spark.createDataFrame(part, SCHEMAS["account_month"]), t.accounts, DEFAULT,
                            t.accounts_unique)
        state = new if state is None else merge_states(state, new)
    same(finish(state), full)


def test_folded_by_year_is_the_profile(tables_small):
    same(folded_by_year(tables_small), shared_profile(tables_small))


def test_stored_state_takes_a_new_month(spark, tables_small, tmp_path):
    months = tables_small.account_month.where("yr >= 1995").cache()
    last = F.col("yr") * 12 + F.col("mo") == months.agg(F.max(F.col("yr") * 12 + F.col("mo"))).first()[0]
    write_state(profile_state(months.where(~last), tables_small.accounts), str(tmp_path / "old"), 4)
    write_state(profile_state(months.where(last), tables_small.accounts), str(tmp_path / "new"), 4)
    names = [f"linelift_state_{uuid.uuid4().hex}" for _ in range(2)]
    old, new = (read_state(spark, str(tmp_path / d), n, 4) for d, n in zip(("old", "new"), names))
    same(finish(merge_states(old, new)), shared_profile(tables_small))
    state = old.join(new, ["account_id", "open_date"], "left_semi").hint("merge")
    assert state.count() <= old.count()
    for n in names:
        spark.sql(f"DROP TABLE {n}")
