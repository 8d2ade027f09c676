import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from fieldspark.plans import oracle, registry
from fieldspark.plans.params import Params

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle.SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=1e-9)


def test_params_clamp():
    assert Params(capacity_hours=0).capacity_hours == 1
    assert Params(speed_kmh=float("nan")).speed_kmh == 45
    assert Params(areas=900).areas == 500


def test_entry(spark):
    assert entry.entry(spark).count() > 1
