"""Every query of the catalogue against its SQL, on the small tables."""

import pytest

from lexigraph.plans import catalogue

from .conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(name, spark, sf, duck):
    same_as_sql(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["tid", "score"]
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
