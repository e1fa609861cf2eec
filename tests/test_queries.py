import pytest

import __spark_entry__
from compare import connect, rows_of, sql_rows
from weftline.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_sql(spark, sf_dir, name):
    cols, rows = rows_of(registry.queries()[name](spark, sf_dir))
    assert cols
    if name in SQL:
        assert (cols, rows) == sql_rows(connect(sf_dir), SQL[name])


def test_entry(spark, sf_dir):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "pair_id" and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
