import __spark_entry__ as entry
import pytest

from tesserae.plans import catalogue

from .conftest import DATA


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).columns


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
