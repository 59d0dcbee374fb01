"""Every query of the catalogue against its SQL, or that it runs where it has none."""

import pytest

from quarry.plans import catalog
from tests.compare import connection, same
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, con, catalog.ORACLES[name])
    else:
        assert df.count() >= 0 and df.columns


def test_partitions_do_not_matter(spark):
    results = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, catalog.QUERIES["t03_rerank"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
