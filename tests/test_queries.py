"""Every core query runs; those with SQL give the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import both

from corpusloom.plans.registry import core_queries, core_sql


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    ours, theirs = both(core_queries()[name], core_sql()[name], spark, sf_dir)
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(core_queries()) - set(core_sql())))
def test_runs(spark, sf_dir, name):
    df = core_queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
