"""Domain views over the driver's tables, in Spark SQL and in DuckDB SQL.

MINUTES(x) and BASE are written for each engine; everything else is common.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-02 00:00:00"
REPORTS_AS_OF = "2024-01-07 12:00:00"

FX_REPORTS = """
SELECT e.event_id AS report_id, concat('raw-', CAST(e.event_id AS VARCHAR(20))) AS raw_event_id,
 CAST(e.user_id % 7 AS INT) AS source_id,
 CASE e.user_id % 7 WHEN 0 THEN 'CITIZEN' WHEN 1 THEN 'SOCIAL' WHEN 4 THEN 'WEATHER_API' WHEN 5 THEN 'WEB_RSS' WHEN 6 THEN 'SATELLITE' ELSE 'GOVERNMENT' END AS source_type,
 concat('x-', CAST(CASE WHEN e.event_id % 50 = 1 THEN e.event_id - 1 ELSE e.event_id END AS VARCHAR(20))) AS external_id,
 e.ts AS collected_at, BASE + MINUTES(e.event_id) AS observed_at, d.text AS raw_text,
 CASE e.event_type WHEN 'click' THEN 'RAIN' WHEN 'view' THEN 'FLOOD' WHEN 'purchase' THEN 'THUNDERSTORM' WHEN 'signup' THEN 'HEATWAVE' ELSE 'FOG' END AS predicted_event_type,
 concat('STATE_', CAST(e.user_id % 5 AS VARCHAR(20))) AS state, concat('DISTRICT_', CAST(e.user_id % 25 AS VARCHAR(20))) AS district,
 CASE WHEN e.event_id % 9 = 0 THEN NULL ELSE CAST(10 + 4 * (e.user_id % 5) AS DOUBLE) + CAST((e.event_id * 37) % 100 AS DOUBLE) / CAST(500 AS DOUBLE) END AS latitude,
 CASE WHEN e.event_id % 9 = 0 THEN NULL ELSE CAST(72 + 3 * (e.user_id % 5) AS DOUBLE) + CAST((e.event_id * 53) % 100 AS DOUBLE) / CAST(500 AS DOUBLE) END AS longitude,
 CASE WHEN e.event_id % 9 = 0 THEN CAST(0.3 AS DOUBLE) WHEN e.event_id % 4 = 0 THEN CAST(1.0 AS DOUBLE) WHEN e.event_id % 4 = 1 THEN CAST(0.6 AS DOUBLE) WHEN e.event_id % 4 = 2 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS location_confidence,
 CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE CAST((e.event_id * 7) % 80 AS DOUBLE) / CAST(10 AS DOUBLE) END AS precipitation_mm,
 CAST(15 AS DOUBLE) + CAST((e.event_id * 3) % 300 AS DOUBLE) / CAST(10 AS DOUBLE) AS temperature_c,
 CAST((e.event_id * 11) % 500 AS DOUBLE) / CAST(10 AS DOUBLE) AS wind_speed_kmh,
 CAST(30 + (e.event_id * 13) % 70 AS DOUBLE) AS humidity_pct,
 CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST((e.event_id * 17) % 24000 AS DOUBLE) END AS visibility_m,
 (e.event_id % 4 = 0) AS has_media, (e.event_id % 12 = 0) AS is_noise,
 CASE WHEN e.event_id % 10 = 7 THEN e.event_id - 1 ELSE NULL END AS duplicate_of_report_id,
 e.value / CAST(500 AS DOUBLE) AS reliability_score, e.text_id
FROM (SELECT ev.*, ev.event_id % (SELECT count(*) FROM fx_documents) AS text_id FROM fx_events ev) e JOIN fx_documents d ON d.doc_id = e.text_id
"""

FX_INCIDENTS = """
SELECT o.o_orderkey AS event_id,
 CASE o.o_orderkey % 7 WHEN 0 THEN 'RAIN' WHEN 1 THEN 'FLOOD' WHEN 2 THEN 'THUNDERSTORM' WHEN 3 THEN 'HEATWAVE' WHEN 4 THEN 'FOG' WHEN 5 THEN 'DUST_STORM' ELSE 'STRONG_WIND' END AS event_type,
 CASE o.o_orderkey % 6 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'CORROBORATING' WHEN 2 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'VERIFIED' WHEN 4 THEN 'REJECTED' ELSE 'RESOLVED' END AS status,
 r.r_name AS state, n.n_name AS district,
 o.o_orderdate + MINUTES((o.o_orderkey * 37) % 1440) AS start_time,
 o.o_orderdate + MINUTES((o.o_orderkey * 37) % 1440 + (o.o_orderkey * 13) % 600) AS last_updated,
 CAST(1 + (o.o_orderkey * 11) % 40 AS INT) AS report_count,
 CAST(1 + (o.o_orderkey * 7) % 6 AS INT) AS source_count,
 CAST((o.o_orderkey * 29) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS evidence_score,
 CAST((o.o_orderkey * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS corroboration_score,
 CAST(FLOOR(((o.o_orderkey * 11) % 40) * ((o.o_orderkey * 3) % 10) / CAST(10 AS DOUBLE)) AS INT) AS flagged_report_count
FROM fx_orders o JOIN fx_customer c ON c.c_custkey = o.o_custkey JOIN fx_nation n ON n.n_nationkey = c.c_nationkey JOIN fx_region r ON r.r_regionkey = n.n_regionkey
"""

FX_ALERTS = """
SELECT event_id AS alert_id, event_id, event_type, state, district,
 CASE WHEN event_id % 2 = 0 THEN 'ORANGE' ELSE 'RED' END AS level,
 CASE event_id % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'CLOSED' END AS status,
 start_time + MINUTES((event_id * 17) % 300) AS raised_at
FROM fx_incidents WHERE event_id % 5 < 2
"""

FX_AUTHORITIES = """
SELECT s.s_suppkey AS authority_id, s.s_name AS name,
 CASE s.s_suppkey % 5 WHEN 0 THEN 'NATIONAL' WHEN 1 THEN 'STATE' WHEN 2 THEN 'STATE' ELSE 'DISTRICT' END AS level,
 CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE r.r_name END AS state,
 CASE WHEN s.s_suppkey % 5 >= 3 THEN n.n_name ELSE NULL END AS district,
 CASE WHEN s.s_suppkey % 3 = 0 THEN 'RED' ELSE 'ORANGE' END AS min_level,
 CASE WHEN s.s_suppkey % 11 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status,
 CASE WHEN s.s_suppkey % 4 = 0 THEN 'HEATWAVE,DUST_STORM' ELSE NULL END AS event_types_csv
FROM fx_supplier s JOIN fx_nation n ON n.n_nationkey = s.s_nationkey JOIN fx_region r ON r.r_regionkey = n.n_regionkey
"""

FX_POSTS = """
SELECT d.doc_id, d.lang, d.source, concat(d.text, CASE d.doc_id % 8 WHEN 0 THEN ' Heavy #Rain and #Rainfall near the river, more rain @IMD' WHEN 1 THEN ' #Flood water, waterlogging and rain' WHEN 2 THEN ' lightning before the squall #MyTown #rain'
 WHEN 3 THEN ' dense FOG, low visibility' WHEN 4 THEN ' dust storm and gusts' WHEN 5 THEN ' #heatwave #IMD' ELSE '' END) AS text FROM fx_documents d
"""

VIEWS = {"fx_posts": FX_POSTS, "fx_reports": FX_REPORTS, "fx_incidents": FX_INCIDENTS, "fx_alerts": FX_ALERTS, "fx_authorities": FX_AUTHORITIES}
TABLES = ("events", "documents", "orders", "customer", "nation", "region", "supplier")


def _call(sql: str, name: str, write) -> str:
    """Calls of name(...), with nested parentheses, from the last to the first."""
    at = len(sql)
    while (at := sql.rfind(f"{name}(", 0, at)) >= 0:
        depth, begin = 1, at + len(name) + 1
        end = begin
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + write(sql[begin : end - 1]) + sql[end:]
    return sql


def spark_sql(sql: str) -> str:
    return _call(sql, "MINUTES", lambda x: f"make_dt_interval(0,0,CAST({x} AS INT),0)").replace("BASE", "TIMESTAMP_NTZ'2024-01-01 00:00:00'")


def duckdb_sql(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f" fx_{t} ", f" {t} ").replace(f" fx_{t})", f" {t})")
    return _call(sql, "MINUTES", lambda x: f"to_minutes(CAST({x} AS BIGINT))").replace("BASE", "TIMESTAMP '2024-01-01 00:00:00'")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, or a table by its name. The views' inputs are registered under names of their own."""
    if name not in VIEWS:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    for t in TABLES:
        spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(f"fx_{t}")
    if name == "fx_alerts":
        view(spark, sf_dir, "fx_incidents").createOrReplaceTempView("fx_incidents")
    return spark.sql(spark_sql(VIEWS[name]))


def with_views(body: str) -> str:
    """DuckDB SQL of a query over the views it names."""
    needed = [v for v in ("fx_posts", "fx_reports", "fx_incidents", "fx_alerts", "fx_authorities") if v in body or (v == "fx_incidents" and "fx_alerts" in body)]
    head = ", ".join(f"{v} AS ({duckdb_sql(VIEWS[v])})" for v in needed)
    body = _call(body.strip(), "count_if", lambda x: f"count(*) FILTER (WHERE {x})")
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
