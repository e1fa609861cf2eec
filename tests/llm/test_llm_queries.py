import pytest

from compare import connect, rows_of, sql_rows
from weftline.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    cols, rows = rows_of(queries.queries()[name](spark, sf_dir))
    assert cols and (rows or name == "p9_found")  # a hundred documents may hold nothing that reaches the mark
    if name in SQL:
        assert (cols, rows) == sql_rows(connect(sf_dir), SQL[name])
