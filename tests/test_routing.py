"""Deliveries of routed alerts: pairs of alerts and authorities aren't shuffled, counts and the outbox don't form them all."""

import duckdb
import pytest

from hazardspark import registry
from hazardspark.operators import lifecycle

SF = "/root/testdata/sf0.001"
ALERTS = "alert_id long, event_type string, state string, district string, level string"
WHO = "authority_id long, status string, level string, state string, district string, min_level string, event_types_csv string, channels array<string>"


def tables(spark):
    alerts = spark.createDataFrame([(1, "FLOOD", "S", "D", "RED"), (2, "FOG", "S", "E", "ORANGE"), (3, "FOG", None, None, "RED"), (4, "FOG", "S", "D", "GREEN")], ALERTS)
    who = [(10, "ACTIVE", "NATIONAL", None, None, "ORANGE", None, ["EMAIL", "SMS"]), (11, "ACTIVE", "DISTRICT", "S", "D", "RED", "FLOOD,FOG", ["EMAIL", "EMAIL"]), (12, "PAUSED", "NATIONAL", None, None, "ORANGE", None, ["EMAIL"]), (13, "ACTIVE", "STATE", "S", None, "RED", None, [])]
    return alerts, spark.createDataFrame(who, WHO)


def told(df):
    return sorted(map(tuple, df.select("alert_id", "authority_id", "channel").collect()))


def test_what_exists_is_left_out_singly_or_by_channel(spark):
    alerts, who = tables(spark)
    every = [(1, 10, "EMAIL"), (1, 10, "SMS"), (1, 11, "EMAIL"), (1, 11, "EMAIL"), (2, 10, "EMAIL"), (2, 10, "SMS"), (3, 10, "EMAIL"), (3, 10, "SMS")]
    assert told(lifecycle.deliveries(alerts, who)) == every
    single = spark.createDataFrame([(1, 10, "EMAIL"), (1, 10, "EMAIL"), (2, 10, "FAX")], "alert_id long, authority_id long, channel string")
    assert told(lifecycle.deliveries(alerts, who, single)) == [x for x in every if x != (1, 10, "EMAIL")]
    by_channel = spark.createDataFrame([(1, "EMAIL"), (1, "EMAIL"), (3, "SMS"), (3, "EMAIL"), (9, "SMS")], "alert_id long, channel string")
    assert told(lifecycle.deliveries(alerts, who, by_channel)) == [(1, 10, "SMS"), (2, 10, "EMAIL"), (2, 10, "SMS")]


def test_codes_of_a_table_are_those_of_the_row(spark):
    rows = [(f"d{i}", c, n, "PENDING" if i % 4 else "SENT", code) for i, (c, n, code) in enumerate((c, n, code) for c in ("WEBHOOK", "SMS") for n in range(3) for code in (None, 204, 500))]
    queue = spark.createDataFrame(rows, "delivery_id string, channel string, attempts int, status string, code int")
    got = lifecycle.attempted(queue)
    assert got.columns == ["delivery_id", "channel", "attempts", "status"]
    assert sorted(got.collect()) == sorted(lifecycle.apply_attempts(queue.drop("code"), queue.where("code is not null")).collect())


@pytest.mark.parametrize("name", ["alert_routing_missing", "delivery_transition"])
def test_pairs_meet_nothing_else(spark, name):
    """The join that makes the pairs is the last one."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "reach" in next(x for x in plan.splitlines() if "Join " in x)


def test_few_pairs_are_formed_for_counts_and_outbox(spark, tmp_path):
    for t in ("events", "documents", "orders", "customer", "nation", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT range AS s_suppkey, 'S' || range AS s_name, CAST(range % 25 AS INTEGER) AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(2000)) TO '{tmp_path}/supplier.parquet'")
    many = registry.QUERIES["delivery_transition"](spark, str(tmp_path)).count()
    for name in ("delivery_stats", "delivery_outbox"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        df.collect()
        made = [n for kind, what, n in _nodes(df._jdf.queryExecution().executedPlan()) if kind.endswith("Join") and "reach" in what]
        assert made and sum(made) < many / 2


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    if "QueryStage" in plan.nodeName():
        plan = plan.plan()
    rows = plan.metrics().get("numOutputRows")
    out = [(plan.nodeName(), plan.simpleString(400), rows.get().value() if rows.isDefined() else 0)]
    kids = plan.children()
    for i in range(kids.size()):
        out += _nodes(kids.apply(i))
    return out
