"""Every registered query against its check SQL, on whole tables of the smallest scale."""

from __future__ import annotations

import pytest
from compare import diff, duck

from terrasig.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, name):
    assert diff(QUERIES[name](spark, SF), con, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_registry_is_complete():
    assert set(CHECKS) <= set(QUERIES)
    assert len(QUERIES) >= 170
