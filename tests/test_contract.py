"""Every catalog query against its SQL on the smallest tables."""

import os
import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as contract
from oracle import DATA, compare, duck
from tallyframe.plans.catalog import CATALOG

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_entry_and_names(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    top = contract.entry(spark)
    assert isinstance(top, DataFrame)
    assert top.columns == ["name", "total_spent"] and top.count() == 5


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(name, CATALOG[name], spark, con, FOLDER)
    assert problem == ""
