"""Every registered query against its DuckDB SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from panelyst.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(found):
    return Counter(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    sql = duck.sql(registry.ORACLES[name])
    assert cols == sorted(sql.columns)
    assert rows(df.select(*cols).collect()) == rows(sql.select(", ".join(cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, DATA).collect()


def test_kurtosis_of_nearly_equal_values_is_that_of_sql(spark, tmp_path):
    pairs = [(49.03, 49.54), (104.68, 107.11), (25.52, 25.49), (85.92, 86.77), (40.45, 39.97), (52.11, 52.17), (80.84, 81.29), (38.79, 38.49), (65.84, 65.26)]
    seen = [(2 * u + i, u, i, "a", x) for u, pair in enumerate(pairs) for i, x in enumerate(pair)]
    df = spark.createDataFrame(seen, "event_id long, user_id long, s long, event_type string, value double")
    df.selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("ewm_kurt", "ewm_skew"):
        found = registry.QUERIES[name](spark, str(tmp_path)).select("event_id", "v").collect()
        assert rows(found) == rows(con.sql(f"select event_id, v from ({registry.ORACLES[name]})").fetchall())


def test_moments_are_rounded_as_in_sql(spark, tmp_path):
    series = [(68.44, 68.22), (74.77, 73.16, 74.77), (46.76, 47.46, 46.34), (49.5, 49.96, 49.8)]
    seen = [(3 * u + i, u, i, "a", x) for u, xs in enumerate(series) for i, x in enumerate(xs)]
    df = spark.createDataFrame(seen, "event_id long, user_id long, s long, event_type string, value double")
    df.selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("ewm_kurt", "ewm_skew"):
        found = registry.QUERIES[name](spark, str(tmp_path)).select("event_id", "v").collect()
        assert rows(found) == rows(con.sql(f"select event_id, v from ({registry.ORACLES[name]})").fetchall())
