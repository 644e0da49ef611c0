import pytest

from cuesmith.catalog import oracle_sql, queries

from .compare import SF_DIR, differences


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    sql = oracle_sql().get(name)
    if sql:
        assert differences(spark, SF_DIR, queries()[name], sql) == ""
    else:
        df = queries()[name](spark, SF_DIR)
        assert df.columns and df.limit(5).collect() is not None
