"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else round(float(v), 9) if isinstance(v, float) else v
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = sql.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_ideograph_count_is_spread(spark):
    """A table of one row group keeps all cores busy."""
    assert spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert QUERIES["ideograph_count"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
