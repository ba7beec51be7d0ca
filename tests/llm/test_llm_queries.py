"""Queries of the operators against their SQL counterparts."""

import pytest
from check import differences

from timberline.llm.registry import REGISTRY, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf_dir, name):
    assert differences(REGISTRY[name](spark, sf_dir), con, SQL[name]) == []


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
