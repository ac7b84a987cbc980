"""Every query of the catalogue against its SQL, or for rows and a schema where there is none."""

import pytest

from sonarframe.plans import catalogue

from . import compare


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(name, spark, sf_dir, con):
    assert compare.differences(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLE_SQL[name], con) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_has_rows(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
