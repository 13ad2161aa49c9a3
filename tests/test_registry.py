"""Every registered query against its DuckDB text on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from logquarry.plans import registry

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_duckdb(spark, duck, name):
    got, want = registry.queries()[name](spark, SMALL).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ([tuple(None if pd.isna(v) else v for v in r) for r in x[sorted(x.columns)].astype(object).itertuples(index=False)] for x in (got, want))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "hits" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sketch_merge_of_many_visitors_a_day(spark, tmp_path):
    """Days with more visitors than a sketch lists one by one; one day lies in both runs, the others in one."""
    spark.range(24_000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice", "timestampadd(DAY, CAST(id % 4 AS INT), TIMESTAMP'1997-03-20 00:00:00') AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["m03_sketch_merge"](spark, str(tmp_path)).select("grain", "period", "same").collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.sql(f"SELECT grain, period, same FROM ({registry.oracle_sql()['m03_sketch_merge']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5
