"""Every query with SQL gives what DuckDB gives on the smallest tables; plans of spatial joins have no nested loop."""

import duckdb
import pytest

import __spark_entry__ as entry
from hazardspark import fixtures, registry
from hazardspark.operators import scoring

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    cell = lambda v: round(float(v), 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)
    return sorted(map(repr, (tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nearby_plan(spark):
    seen = fixtures.view(spark, SF, "fx_reports")  # the view itself joins a one-row count, so its rows are copied
    plan = scoring.nearby_sources(spark.createDataFrame(seen.limit(50).collect(), seen.schema))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    "status,reports,sources,evidence,flagged,level",
    [("DETECTED", 1, 1, 0.10, 0, "GREEN"), ("DETECTED", 3, 2, 0.40, 0, "YELLOW"), ("DETECTED", 12, 3, 0.52, 0, "ORANGE"), ("DETECTED", 30, 5, 0.70, 0, "RED"), ("DETECTED", 500, 1, 0.95, 0, "GREEN"), ("DETECTED", 40, 5, 0.80, 38, "YELLOW"), ("VERIFIED", 1, 1, 0.1, 0, "ORANGE"), ("REJECTED", 40, 5, 0.9, 0, "GREEN")],
)
def test_warning(spark, status, reports, sources, evidence, flagged, level):
    df = spark.createDataFrame([(status, reports, sources, evidence, flagged)], "status string, report_count int, source_count int, evidence_score double, flagged_report_count int")
    assert scoring.warning_level(df).first().warning_level == level
