"""Every registered query against DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__
from checks.compare import difference, duck
from checks.queries import ORACLE, QUERIES
from checks.views import Views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_statement_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("file", ["isd_file", "gsod_file", "flight_file"])
def test_raw_files_are_packed(spark, file):
    """Files that every reader scans are written at a fraction of their text, in parts of bounded length."""
    views = Views(spark, FOLDER)
    path = getattr(views, file)()
    written = sum(os.path.getsize(f"{path}/{name}") for name in os.listdir(path) if name.startswith("part-"))
    text = spark.read.text(path).selectExpr("sum(length(value) + 1)").first()[0]
    assert written < text / 2 and spark.read.text(path).count() >= views.table("lineitem").count()
