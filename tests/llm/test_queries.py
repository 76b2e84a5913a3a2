import pytest
from tests.oracle import DATA, compare

from spanforge.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, queries.queries(), SQL, name)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_one_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.queries()[name](spark, DATA).count() == n
