"""Every registered query of the log engine against DuckDB, on the smallest tables."""

import pytest
from oracle import same

from logloom.plans import catalogue, details, streams  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    same(catalogue.QUERIES[name](spark, FOLDER), catalogue.ORACLES[name], FOLDER)


def test_all_have_oracles():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
