"""Every query of the library against its SQL; the few without SQL have to give rows."""

import pytest

from loomline.queries import ORACLE, QUERIES

from .oracle import SF, database, spark_rows, sql_rows

NO_SQL = {"src7_file_inventory", "jn14_greedy_match"}


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    assert rows
    if name in NO_SQL:
        assert name not in ORACLE
    else:
        assert (names, rows) == sql_rows(con, ORACLE[name])
