import pytest

import __spark_entry__ as entry
from spanweave.plans import catalog

from .compare import duck, rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck(catalog.ORACLE_SQL[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0, name


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "type", "start_time", "end_time", "peak"] and df.count() > 0


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = catalog.QUERIES["agg_avg_over_time"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
