"""Every query that SQL can express gives the rows of its SQL; the others run."""

import pytest
from oracle import compare

from quarry import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, SF, name, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
