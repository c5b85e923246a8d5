import os

import pytest

from proseline.plans import registry

from .oracle import connection, rows_of_df, rows_of_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_as_the_sql(spark, db, name):
    assert rows_of_df(registry.QUERIES[name](spark, SF)) == rows_of_sql(db, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_partitioning_plays_no_part(spark):
    from proseline.operators import check

    docs = registry.docs(spark, SF)
    one, many = (sorted(map(str, check.reports(check.checked(docs.repartition(n))).select("doc_id", "score", "n_findings").collect())) for n in (1, 7))
    assert one == many
