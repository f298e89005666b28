import pytest

from kvlake.plans import catalog
from tests.oracle import SF, connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_equals_sql(spark, con, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == sql_rows(con, catalog.SQL[name])


def test_snapshot_predicate_reaches_the_scan(spark):
    from kvlake.operators import visible
    from kvlake.sources import tables

    plan = visible.visible(tables.event_log(spark, SF), 500)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(event_id,500)" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
