"""Every core query with SQL against it, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import connect, same
from voxframe.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, small, con, name):
    same(con, registry.queries()[name](spark, small), registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_runs(spark, small, name):
    assert registry.queries()[name](spark, small).columns
