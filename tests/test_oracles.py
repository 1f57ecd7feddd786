"""Every reference query against its SQL, and the row-only ones for rows."""

from __future__ import annotations

import pytest

from tests.oracle import compare, connect
from trawl.catalog import load

REGISTRY = load()
ORACLES = REGISTRY.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    compare(REGISTRY.callables()[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.callables()) - set(ORACLES)))
def test_has_rows(spark, sf, name):
    df = REGISTRY.callables()[name](spark, sf)
    assert df.columns and df.count() > 0
