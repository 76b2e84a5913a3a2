import pytest
from tests.oracle import DATA, compare

from spanforge.plans import queries as core

SQL = core.oracle_sql()
QUERIES = core.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, QUERIES, SQL, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_selection_reads_few_columns(spark):
    from spanforge.operators.stats import kernel_stats
    from spanforge.fixtures import spans_of_events

    plan = kernel_stats(spans_of_events(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    read = [x for x in plan.split("\n") if "FileScan" in x][0]
    assert "user_id" not in read.split("ReadSchema")[1]
