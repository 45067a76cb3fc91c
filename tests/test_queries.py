import os

import duckdb
import pytest

from tripforge.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = db.sql(registry.ORACLES[name]).df()[list(got.columns)]
    keys = list(got.columns)
    got, want = (x.convert_dtypes().sort_values(keys, ignore_index=True).astype(str) for x in (got, want))  # nulls don't make integers fractions
    assert len(got) == len(want)
    assert (got == want).all().all()
