"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from compare import check, connect  # noqa: E402
from workload.catalog import QUERIES, SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NO_SQL = {"draw", "poisson_counts", "synthesize_mutations"}


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_only_random_draws_have_no_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    assert check(spark, db, FOLDER, name, SQL.get(name)) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["population", "statistic", "value"] and df.count() > 0
