"""Every registered query against its SQL counterpart."""

import os

import pytest
from check import connect, differences

from timberline.plans.catalog import REGISTRY
from timberline.plans.oracle import SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_a_counterpart():
    assert set(REGISTRY) == set(SQL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert differences(REGISTRY[name](spark, DATA), con, SQL[name]) == []


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 512
