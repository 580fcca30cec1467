"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    flagship = entry(spark)
    assert flagship.columns == ["cohort", "sample_id", "feature_name", "database_id", "value", "z"]
    assert flagship.count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    _, count, problem = compare(spark, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert not problem, problem
    assert count > 0
