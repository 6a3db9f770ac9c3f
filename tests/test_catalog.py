import pytest

from tempora.plans import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        same(df, duck, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0
