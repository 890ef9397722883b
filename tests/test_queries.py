"""Every named query with SQL gives the SQL's rows; the others give a stable schema."""

import pytest
from oracle import check

from siftline.plans.oracle import oracle_sql
from siftline.plans.queries import queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    check(spark, small, queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_runs(spark, small, name):
    df = queries()[name](spark, small)
    assert df.columns and df.count() > 0


def test_call_statistics_cover_all_rows(spark, small):
    assert queries()["api_call_stats"](spark, small).first().n_rows == spark.read.parquet(f"{small}/dataset.parquet").count()
