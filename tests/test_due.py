"""Sources that are due, on ids that the given tables are too small to hold."""

import duckdb
import pytest

from hazardspark import registry
from hazardspark.operators import lifecycle


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables with suppliers up to 10,000."""
    at = tmp_path_factory.mktemp("larger")
    for t in ("events", "documents", "orders", "customer", "nation", "region"):
        (at / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    duckdb.sql(f"COPY (SELECT range AS s_suppkey, 'S' || range AS s_name, CAST(range % 25 AS INTEGER) AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(10000)) TO '{at}/supplier.parquet'")
    return str(at)


def test_an_interval_of_none_is_over(spark, larger):
    con = duckdb.connect()
    for t in ("supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from read_parquet('{larger}/{t}.parquet')")
    want = sorted(r[0] for r in con.sql(registry.ORACLE["due_sources"]).fetchall())
    assert sorted(r[0] for r in registry.QUERIES["due_sources"](spark, larger).collect()) == want and 4850 in want


def test_a_source_waits_a_second_unless_told(spark):
    rows = spark.createDataFrame([(1, "ACTIVE", 0), (2, "ACTIVE", 1)], "id int, status string, interval_s int").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS last_success")
    assert [r.id for r in lifecycle.due(rows, "2024-01-01 00:00:00").collect()] == []
    assert [r.id for r in lifecycle.due(rows, "2024-01-01 00:00:00", least=0).collect()] == [1]
    assert [r.id for r in lifecycle.due(rows, "2024-01-01 00:00:01").collect()] == [1, 2]
