"""The alert state machine: raised, escalated in place, acknowledged again, closed with a reason, and nothing the second time."""

from pyspark.sql import functions as F

from hazardspark.operators import lifecycle

EVENTS = "event_id long, event_type string, state string, district string, status string, report_count int, source_count int, evidence_score double, corroboration_score double, flagged_report_count int"
ALERTS = "alert_id long, event_id long, level string, status string, raised_at timestamp_ntz, acknowledged_by string, note string"


def _event(i, reports, sources, evidence, status="NEEDS_REVIEW", flagged=0, support=0.7):
    return (i, "FLOOD", "S", "D", status, reports, sources, evidence, support, flagged)


def _tables(spark):
    events = [
        _event(1, 30, 5, 0.7), _event(2, 30, 5, 0.7), _event(3, 12, 3, 0.55), _event(4, 12, 3, 0.55, flagged=8), _event(5, 12, 3, 0.55, "REJECTED"), _event(6, 1, 1, None, support=None), _event(7, 12, 3, 0.55), _event(8, 3, 2, 0.4, "VERIFIED", support=0.1),
    ]
    alerts = [(11, 2, "ORANGE", "ACKNOWLEDGED", "desk", "kept"), (12, 3, "RED", "ACTIVE", None, None), (13, 4, "ORANGE", "ACTIVE", None, None), (14, 5, "ORANGE", "ACKNOWLEDGED", "desk", None), (15, 7, "ORANGE", "CLOSED", None, None), (16, 99, "RED", "ACTIVE", None, None)]
    rows = [(*a[:4], None, *a[4:]) for a in alerts]
    return spark.createDataFrame(rows, ALERTS).withColumn("raised_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), spark.createDataFrame(events, EVENTS)


def test_reasons(spark):
    got = {r.event_id: r for r in lifecycle.warning_reasons(_tables(spark)[1]).collect()}
    assert got[1].reasons == ["30 reports from 5 independent sources, evidence 70%", "observed weather agrees (70%)"] and got[1].warning_level == "RED"
    assert got[4].capped_by == "most contributing reports flagged for credibility" and got[4].warning_level == "YELLOW" and got[1].capped_by is None
    assert got[5].reasons == ["event rejected by review"] and got[6].reasons == ["insufficient independent corroboration"]
    assert got[8].reasons == ["2 independent sources corroborating", "verified by a human reviewer"] and got[8].warning_level == "ORANGE"


def test_alerts_after_a_look_at_events(spark):
    alerts, events = _tables(spark)
    now, changes = lifecycle.evaluate_alerts(alerts, events, "2024-01-01 06:00:00")
    assert {(r.event_id, r.change, r.level, r.previous) for r in changes.collect()} == {(1, "RAISE", "RED", None), (2, "ESCALATE", "RED", "ORANGE"), (4, "CLOSE", "YELLOW", "ORANGE"), (5, "CLOSE", "GREEN", "ORANGE"), (7, "RAISE", "ORANGE", None), (8, "RAISE", "ORANGE", None)}
    rows = {r.alert_id: r for r in now.collect()}
    assert len(rows) == 9 == now.count()
    up = rows[11]
    assert (up.level, up.status, up.previous_level, up.acknowledged_by, up.note, str(up.escalated_at)) == ("RED", "ACTIVE", "ORANGE", None, "kept", "2024-01-01 06:00:00")
    assert up.evidence_snapshot.report_count == 30 and up.evidence_snapshot.warning_reasons[1] == "observed weather agrees (70%)" and up.action == "Warning — take action"
    assert (rows[12].level, rows[12].status) == ("RED", "ACTIVE") and rows[12].evidence_snapshot is None
    assert rows[13].closed_reason == "event de-escalated to YELLOW" and rows[14].closed_reason == "event rejected by review" and rows[14].acknowledged_by == "desk" and rows[14].level == "ORANGE"
    assert rows[15].status == "CLOSED" and rows[16].status == "ACTIVE"
    new = {r.event_id: r for i, r in rows.items() if i not in range(11, 17)}
    assert set(new) == {1, 7, 8} and new[1].headline == "Flooding reported across D, S" and new[7].status == "ACTIVE" and new[7].evidence_snapshot.evidence_score == 0.55


def test_looking_twice_changes_nothing(spark):
    alerts, events = _tables(spark)
    now, _ = lifecycle.evaluate_alerts(alerts, events, "2024-01-01 06:00:00")
    again, changes = lifecycle.evaluate_alerts(now, events, "2024-01-01 07:00:00")
    assert changes.count() == 0 and {tuple(map(str, r)) for r in again.collect()} == {tuple(map(str, r)) for r in now.collect()}
    none, raised = lifecycle.evaluate_alerts(alerts.limit(0), events.limit(0), "2024-01-01 07:00:00")
    assert none.count() == 0 and raised.count() == 0
