"""Decisions, alerts, deliveries, bulletins and stale events: each a function from tables to new tables, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import rules
from hazardspark.operators.scoring import rank_of, route, warning_level

OPEN = ["DETECTED", "CORROBORATING", "NEEDS_REVIEW"]
DECISIONS = {"VERIFY": "VERIFIED", "REJECT": "REJECTED", "RESOLVE": "RESOLVED"}


def _words(mapping: dict, key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(key))


def place(unknown: str) -> Column:
    both = F.col("state").isNotNull() & F.col("district").isNotNull() & (F.col("state") != F.col("district"))
    return F.when(both, F.concat_ws(", ", "district", "state")).otherwise(F.coalesce("district", "state", F.lit(unknown)))


def headline() -> Column:
    return F.concat(_words(rules.PHRASES, "event_type"), F.lit(" reported across "), place("an unresolved location"))


def percent(x: Column) -> Column:
    """A share as whole percent, halves to the even one."""
    return F.concat(F.bround(F.coalesce(x, F.lit(0.0)) * 100, 0).cast("long").cast("string"), F.lit("%"))


def bulletins(events: DataFrame, as_of: str | None = None, issuer: str = "this service") -> DataFrame:
    """The advisory of each event, from templates: confidence by corroboration (not volume), and the flagged share where it is a quarter or more.

    warning_level is GREEN where events have none. as_of is the time of issue, null where not given.
    """
    level = F.coalesce("warning_level", F.lit("GREEN")) if "warning_level" in events.columns else F.lit("GREEN")
    confidence = F.when((F.col("source_count") >= 4) & (F.col("evidence_score") >= 0.6), "high").when((F.col("source_count") >= 3) & (F.col("evidence_score") >= 0.45), "medium").otherwise("low")
    flagged = (F.col("report_count") > 0) & (F.col("flagged_report_count") / F.col("report_count") >= 0.25) & (F.col("flagged_report_count") > 0)
    count = lambda c: F.col(c).cast("string")
    note = F.when(flagged, F.concat(F.lit(" "), count("flagged_report_count"), F.lit(" of "), count("report_count"), F.lit(" contributing reports are flagged for credibility review."))).otherwise("")
    what, where = _words(rules.SITUATIONS, "event_type"), place("the affected area")
    guidance = F.element_at(F.create_map(*[x for k, v in rules.SAFETY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("event_type"))
    got = events.select(
        "event_id", level.alias("level"), F.concat(F.regexp_replace(what, " (is|are) being reported", ""), F.lit(" — "), where).alias("headline"), F.concat(what, F.lit(" across "), where, F.lit(".")).alias("situation"),
        _words(rules.EXPECT, "event_type").alias("expect"), guidance.alias("safety"), confidence.alias("confidence"), note.alias("note"),
        F.concat(count("report_count"), F.lit(" reports from "), count("source_count"), F.lit(" independent sources; reliability "), percent(F.col("evidence_score")), F.lit(", observed-weather agreement "), percent(F.col("corroboration_score")), F.lit(".")).alias("evidence_line"),
        F.concat(_words(rules.SITUATIONS_HI, "event_type"), F.lit(" — "), where).alias("headline_hi"),
        (F.date_format(F.lit(as_of).cast("timestamp_ntz"), "dd MMM yyyy, HH:mm 'UTC'")).alias("issued_at"),
    )
    got = got.withColumn("action", _words(rules.ACTIONS, "level")).withColumn("action_hi", _words(rules.ACTIONS_HI, "level")).withColumn("confidence_note", F.concat(_words(rules.CONFIDENCE_NOTES, "confidence"), "note")).drop("note")
    lines = [
        F.concat(F.lit("["), F.col("level"), F.lit("] "), F.col("headline")), F.lit(""), F.col("situation"), F.lit(""), F.concat(F.lit("WHAT TO EXPECT: "), F.col("expect")), F.lit(""), F.lit("WHAT TO DO:"),
        F.array_join(F.transform("safety", lambda s: F.concat(F.lit("  • "), s)), "\n"), F.lit(""), F.concat(F.lit("CONFIDENCE: "), F.upper("confidence"), F.lit(" — "), F.col("confidence_note")),
        F.concat(F.lit("EVIDENCE: "), F.col("evidence_line")), F.concat(F.lit("ISSUED: "), F.coalesce("issued_at", F.lit(""))),
        F.lit("Situation is being monitored continuously; this advisory reflects reports received up to the time of issue."), F.lit(""),
        F.lit(f"Generated by {issuer} from aggregated public and agency reports. Not an official forecast. Review before public issue."),
    ]
    return got.withColumn("text", F.array_join(F.array(*lines), "\n"))


def warning_reasons(events: DataFrame) -> DataFrame:
    """warning_level() with reasons, an array of texts in the order in which they were found, and capped_by, null where nothing held the level down."""
    got = warning_level(events)
    said = lambda wording, *x: F.format_string(wording, *x)
    name, reports, sources, evidence = F.lit("GREEN"), F.col("report_count"), F.col("source_count"), F.coalesce("evidence_score", F.lit(0.0))
    for step, least_reports, least_sources, least in reversed(rules.WARNING_STEPS):
        name = F.when((reports >= least_reports) & (sources >= least_sources) & (evidence >= least), step).otherwise(name)
    why = F.when(name.isin("RED", "ORANGE"), said(rules.REASON_COUNTS, reports, sources, percent(evidence))).when(name == "YELLOW", said(rules.REASON_SOURCES, sources)).otherwise(rules.REASON_NONE)
    held = F.when(F.col("capped"), "YELLOW").otherwise(name)  # what verification then found
    lifted = F.when((F.col("status") == "VERIFIED") & held.isin("GREEN", "YELLOW"), rules.REASON_VERIFIED)
    agrees = F.when(F.col("corroboration_score") >= rules.AGREEMENT, said(rules.REASON_AGREES, percent(F.col("corroboration_score"))))
    shut = F.col("status").isin("REJECTED", "RESOLVED")
    reasons = F.when(shut, F.array(said(rules.REASON_SHUT, F.lower("status")))).otherwise(F.array_compact(F.array(why, lifted, agrees)))
    return got.withColumn("reasons", reasons).withColumn("capped_by", F.when(F.col("capped"), rules.REASON_CAP))


def snapshot(as_of: str) -> Column:
    """The evidence that justified an alert, as it was at as_of; of events with warning_reasons()."""
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    return F.struct("report_count", "source_count", score("evidence_score"), score("corroboration_score"), "flagged_report_count", "severity", "status", F.col("reasons").alias("warning_reasons"), F.lit(as_of).cast("timestamp_ntz").alias("frozen_at"))


def evaluate_alerts(alerts: DataFrame, events: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, changes) after events were looked at again: raised, escalated in place or closed; a second run on its own result changes nothing.

    An event's live alert is its latest ACTIVE or ACKNOWLEDGED one. Below ORANGE it is closed with the reason; above its level it keeps its id, gets the new
    level, action and snapshot, and is ACTIVE again with nobody's acknowledgement; at or below its level it stays. Without a live alert ORANGE or more raises a
    new one, whose id is a hash of event and time. changes(event_id, alert_id, change, level, previous): RAISE and ESCALATE are what routing takes up. Events without an alert and below ORANGE, and alerts of unknown events, stay as they are.
    alerts: alert_id long, event_id, level, status, raised_at; what else an alert has (below) is null where the table lacks it, and other columns are kept.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    seen = warning_reasons(events)
    seen = seen.select("event_id", F.col("warning_level").alias("to"), F.col("status").alias("event_status"), snapshot(as_of).alias("new_snapshot"), *(F.col(c).alias(f"new_{c}") for c in ("event_type", "state", "district")), headline().alias("new_headline"))
    fields = {"previous_level": "string", "action": "string", "evidence_snapshot": seen.schema["new_snapshot"].dataType, "escalated_at": "timestamp_ntz", "acknowledged_at": "timestamp_ntz", "acknowledged_by": "string", "closed_at": "timestamp_ntz", "closed_reason": "string", "headline": "string"}
    alerts = alerts.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in fields.items() if c not in alerts.columns))
    latest = F.max_by(F.struct("alert_id", "level"), F.struct("raised_at", (-F.col("alert_id")).alias("first")))
    live = alerts.where("status in ('ACTIVE', 'ACKNOWLEDGED')").groupBy("event_id").agg(latest.alias("held")).select("event_id", "held.*")
    met = seen.join(live, "event_id", "left")
    rank, held = rank_of(F.col("to"), rules.WARNING_LEVELS), rank_of(F.col("level"), rules.WARNING_LEVELS)
    change = F.when((rank < 2) & F.col("level").isNotNull(), "CLOSE").when((rank >= 2) & F.col("level").isNull(), "RAISE").when((rank >= 2) & (rank > held), "ESCALATE")
    met = met.withColumn("change", change).where("change is not null")
    reason = F.when(F.col("event_status").isin("REJECTED", "RESOLVED"), F.format_string(rules.REASON_SHUT, F.lower("event_status"))).otherwise(F.format_string(rules.REASON_CALMER, F.col("to")))
    met = met.withColumn("reason", F.when(F.col("change") == "CLOSE", reason)).withColumn("alert_id", F.coalesce("alert_id", F.xxhash64("event_id", F.lit(as_of)))).withColumnRenamed("level", "previous")
    up, shut = F.col("change") == "ESCALATE", F.col("change") == "CLOSE"
    new = {
        "status": F.when(up, "ACTIVE").when(shut, "CLOSED"), "level": F.when(up, F.col("to")), "previous_level": F.when(up, F.col("level")), "action": F.when(up, _words(rules.ACTIONS, "to")), "evidence_snapshot": F.when(up, F.col("new_snapshot")),
        "escalated_at": F.when(up, now), "closed_at": F.when(shut, now), "closed_reason": F.col("reason"),
    }
    again = up & (F.col("status") == "ACKNOWLEDGED")
    kept = lambda c: F.when(F.coalesce(again, F.lit(False)), None).otherwise(F.col(c)) if c.startswith("acknowledged") else F.coalesce(new[c], c) if c in new else F.col(c)
    changed = alerts.join(met.where("change <> 'RAISE'").select("alert_id", "change", "to", "new_snapshot", "reason"), "alert_id", "left").select(*(kept(c).alias(c) for c in alerts.columns))
    first = {"alert_id": F.col("alert_id"), "event_id": F.col("event_id"), "level": F.col("to"), "status": F.lit("ACTIVE"), "raised_at": now, "action": _words(rules.ACTIONS, "to"), "evidence_snapshot": F.col("new_snapshot"), "headline": F.col("new_headline"), "event_type": F.col("new_event_type"), "state": F.col("new_state"), "district": F.col("new_district")}
    raised = met.where("change = 'RAISE'").select(*(first.get(c, F.lit(None)).cast(alerts.schema[c].dataType).alias(c) for c in alerts.columns))
    return changed.unionByName(raised), met.select("event_id", "alert_id", "change", F.col("to").alias("level"), "previous", "reason")


def apply_verdicts(events: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, history, rejects, audit) for decisions(event_id, action, by, at), folded in order of time and action.

    Only a rejected or resolved event refuses a decision; unknown events and actions are refused, too, and change nothing.
    A decision that leaves the status as it is has an audit row and no history. Levels follow from scoring.warning_level of the new events.
    """
    met = decisions.withColumn("to", _words(DECISIONS, "action")).join(events.select("event_id", F.col("status").alias("first")), "event_id", "left")
    before = Window.partitionBy("event_id").orderBy("at", "action").rowsBetween(Window.unboundedPreceding, -1)
    shut = F.col("first").isin("REJECTED", "RESOLVED") | F.coalesce(F.max(F.col("to").isin("REJECTED", "RESOLVED")).over(before), F.lit(False))
    met = met.withColumn("before", F.coalesce(F.last("to", ignorenulls=True).over(before), "first"))
    met = met.withColumn("why", F.when(F.col("first").isNull(), "UNKNOWN_EVENT").when(F.col("to").isNull(), "UNKNOWN_ACTION").when(shut, "CLOSED"))
    good = met.where("why is null")
    history = good.where("before <> to").select("event_id", F.col("before").alias("old_status"), F.col("to").alias("new_status"), F.col("by").alias("changed_by"), F.col("at").alias("created_at"))
    audit = good.select(F.concat(F.lit("event."), F.lower("to")).alias("action"), F.lit("event").alias("target_type"), F.col("event_id").cast("string").alias("target_id"), F.col("by").alias("actor"), F.col("at").alias("created_at"), F.struct(F.col("before").alias("from"), "to").alias("details"))
    to = good.groupBy("event_id").agg(F.max_by("to", F.struct("at", "action")).alias("to"))
    now = events.join(to, "event_id", "left").withColumn("status", F.coalesce("to", "status")).drop("to")
    return now, history, met.where("why is not null").select("event_id", "action", "at", "why"), audit


def apply_alert_actions(alerts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, rejects, audit) for actions(alert_id, action ACKNOWLEDGE or CLOSE, at), in order of time: a closed alert refuses both, acknowledging again changes nothing and leaves no audit row."""
    met = actions.join(alerts.select("alert_id", F.col("status").alias("first")), "alert_id", "left")
    before = Window.partitionBy("alert_id").orderBy("at", "action").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("action").isin("ACKNOWLEDGE", "CLOSE")
    had = lambda what: F.coalesce(F.max(F.col("action") == what).over(before), F.lit(False))
    shut = (F.col("first") == "CLOSED") | had("CLOSE")
    met = met.withColumn("why", F.when(F.col("first").isNull(), "UNKNOWN_ALERT").when(shut, "CLOSED").when(~known, "UNKNOWN_ACTION"))
    met = met.withColumn("again", (F.col("action") == "ACKNOWLEDGE") & ((F.col("first") == "ACKNOWLEDGED") | had("ACKNOWLEDGE")))
    good = met.where("why is null")
    to = good.groupBy("alert_id").agg(F.when(F.bool_or(F.col("action") == "CLOSE"), "CLOSED").otherwise("ACKNOWLEDGED").alias("to"))
    now = alerts.join(to, "alert_id", "left").withColumn("status", F.coalesce("to", "status")).drop("to")
    audit = good.where("not again").select(F.concat(F.lit("alert."), F.lower("action")).alias("action"), F.lit("alert").alias("target_type"), F.col("alert_id").cast("string").alias("target_id"), F.col("at").alias("created_at"))
    return now, met.where("why is not null").select("alert_id", "action", "at", "why"), audit


def apply_changes(dim: DataFrame, changes: DataFrame, key: str, fields: list[str], at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(dim, audit): null in changes leaves a field; the audit has a row for each field that a change really changed. Unknown keys are left out.

    Several changes of a key are taken in the order of the column at, ties and a missing column in the order of their values; the last one stays.
    """
    order = F.lit(0) if at is None else F.col(at)
    asked = changes.select(key, order.alias("_at"), F.inline(F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("new"))) for f in fields]))))
    held = dim.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("held")) for f in fields])))
    w = Window.partitionBy(key, "field").orderBy("_at", "new")
    told = asked.join(held, [key, "field"]).withColumn("old", F.when(F.row_number().over(w) == 1, F.col("held")).otherwise(F.lag("new").over(w)))
    audit = told.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "field", "old", "new")
    last = changes.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(order.alias("at"), F.col(f).cast("string").alias("value")))).alias(f"new_{f}") for f in fields))
    met = dim.join(last, key, "left")
    return met.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in dim.columns)), audit


def resolve_stale(events: DataFrame, as_of: str, hours: int = rules.STALE_HOURS) -> tuple[DataFrame, DataFrame]:
    """(events, history): open events without an update for so long are resolved; their level and alerts stay."""
    stale = F.col("status").isin(*OPEN) & (F.col("last_updated") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    history = events.where(stale).select("event_id", F.col("status").alias("old_status"), F.lit("RESOLVED").alias("new_status"), F.lit("no reports lately").alias("reason"))
    return events.withColumn("status", F.when(stale, "RESOLVED").otherwise(F.col("status"))), history


def deliveries(alerts: DataFrame, authorities: DataFrame, existing: DataFrame | None = None, of_alert: list[str] = ["alert_id"], of_authority: list[str] = ["authority_id"]) -> DataFrame:  # noqa: B006
    """(alert_id, authority_id, channel) still to be queued, on raising and on escalating: one for each channel of a routed authority, less those that exist.

    authorities has channels, an array. existing(alert_id, authority_id, channel): single deliveries; without authority_id: channels by which an alert went to all its authorities.
    The latter, and channels, go along with alerts and authorities, so that pairs aren't shuffled; so do of_alert and of_authority, the columns given beside channel.
    """
    single = existing is not None and "authority_id" in existing.columns
    if existing is None or single:
        alerts = alerts.withColumn("sent", F.lit(None).cast("array<string>"))
    else:
        alerts = alerts.join(existing.groupBy("alert_id").agg(F.collect_set("channel").alias("sent")), "alert_id", "left")
    left = F.filter("channels", lambda x: ~F.coalesce(F.array_contains("sent", x), F.lit(False)))
    want = route(alerts, authorities, of_alert=[*of_alert, "sent"], of_authority=[*of_authority, "channels"]).select(*of_alert, *of_authority, F.explode(left).alias("channel"))
    return want.join(existing.select("alert_id", "authority_id", "channel").distinct(), ["alert_id", "authority_id", "channel"], "left_anti") if single else want


def attempted(queue: DataFrame, most: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Deliveries after an attempt each, whose code is in the row (null: none): a webhook's 2xx is SENT, else PENDING until FAILED; others are SIMULATED."""
    tried = (F.col("status") == "PENDING") & F.col("code").isNotNull()
    n = F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    to = F.when(~tried, F.col("status")).when(F.col("channel") != "WEBHOOK", "SIMULATED").when(F.col("code").between(200, 299), "SENT").when(F.col("attempts") + 1 >= most, "FAILED").otherwise("PENDING")
    return queue.select(*(to.alias("status") if c == "status" else n.alias("attempts") if c == "attempts" else F.col(c) for c in queue.columns if c != "code"))


def apply_attempts(queue: DataFrame, results: DataFrame, most: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """attempted(), the codes taken from results(delivery_id, code)."""
    return attempted(queue.join(results.select("delivery_id", "code"), "delivery_id", "left").select(*queue.columns, "code"), most)


def classes(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The distinct keys, and how many rows have them as number."""
    return rows.groupBy(*keys).agg(F.count("*").alias(number))


def alert_transitions(history: DataFrame) -> DataFrame:
    """(event_id, seq, change, level, previous) from a history(event_id, seq, level) of warning levels.

    RAISE where a level of ORANGE or more meets no live alert, ESCALATE in place
    above the highest of this alert, CLOSE below ORANGE; anything else is no change. An event's next alert is a new one.
    """
    w = Window.partitionBy("event_id").orderBy("seq")
    rank = rank_of(F.col("level"), rules.WARNING_LEVELS)
    rows = history.select("event_id", "seq", "level", rank.alias("rank")).withColumn("live", F.col("rank") >= 2).withColumn("was", F.coalesce(F.lag("live").over(w), F.lit(False)))
    rows = rows.withColumn("alert_no", F.sum((F.col("live") & ~F.col("was")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_alert = Window.partitionBy("event_id", "alert_no", "live").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("highest", F.max("rank").over(of_alert))
    change = F.when(F.col("live") & ~F.col("was"), "RAISE").when(F.col("live") & (F.col("rank") > F.col("highest")), "ESCALATE").when(~F.col("live") & F.col("was"), "CLOSE")
    levels = F.array(*map(F.lit, rules.WARNING_LEVELS))
    return rows.withColumn("change", change).where("change is not null").select("event_id", "seq", "alert_no", "change", "level", F.when(F.col("change") == "ESCALATE", F.element_at(levels, F.col("highest") + 1)).alias("previous"))


def status_history(rows: DataFrame) -> DataFrame:
    """(event_id, seq, old_status, new_status) where the status of history(event_id, seq, status) changes."""
    w = Window.partitionBy("event_id").orderBy("seq")
    got = rows.select("event_id", "seq", F.lag("status").over(w).alias("old_status"), F.col("status").alias("new_status"))
    return got.where("old_status is null or old_status <> new_status")


def due(sources: DataFrame, as_of: str, least: int = 1) -> DataFrame:
    """Active sources that never succeeded or whose interval (least seconds at least) has passed."""
    gone = F.timestamp_diff("SECOND", F.col("last_success"), F.lit(as_of).cast("timestamp_ntz"))
    return sources.where((F.col("status") == "ACTIVE") & (F.col("last_success").isNull() | (gone >= F.greatest(F.lit(least), F.col("interval_s")))))
