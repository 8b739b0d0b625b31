"""Every query with SQL agrees with DuckDB on the small tables."""

import pytest
from check_oracle import compare, duck

from wardline.plans import catalog

STREAMS = [n for n in catalog.ORACLES if n.endswith("_stream")]
BATCH = [n for n in catalog.ORACLES if n not in STREAMS]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", BATCH)
def test_batch(spark, sf, con, name):
    ok, msg = compare(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])
    assert ok, msg


@pytest.mark.parametrize("name", STREAMS)
def test_stream(spark, sf, con, name):
    ok, msg = compare(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])
    assert ok, msg


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
