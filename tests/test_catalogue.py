"""Every query of the catalogue against its SQL on the smallest test data."""

from pathlib import Path

import pytest
from check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    if name not in oracle_sql():
        assert queries()[name](spark, SF_DIR).count() > 0
        return
    _, _, _, problems, types = differences(spark, duck, name, queries()[name], oracle_sql()[name], SF_DIR)
    assert not problems and not types


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
