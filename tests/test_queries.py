import pytest
from compare import spark_rows, sql_rows

from docloom import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    columns, got = spark_rows(q.queries()[name](spark, SF))
    assert got, "a query without rows proves nothing"
    if name in q.oracle_sql():
        names, want = sql_rows(q.oracle_sql()[name], SF)
        assert columns == names
        assert got == want
