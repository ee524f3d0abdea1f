"""Filters, pages and layers that a user asks for with parameters. A parameter that is None filters nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark import rules
from hazardspark.operators.scoring import rank_of

PRESETS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "all": None}
ORDERS = {"event_type": rules.EVENT_TYPES, "status": rules.EVENT_STATUSES, "severity": ["LOW", "MODERATE", "HIGH", "SEVERE"], "warning_level": rules.WARNING_LEVELS}
MAP_EVENT = ["event_id", "event_type", "status", "severity", "warning_level", "state", "district", "start_time", "last_updated", "report_count", "source_count", "evidence_score", "latitude", "longitude"]
MAP_REPORT = ["report_id", "predicted_event_type", "latitude", "longitude", "source_type", "observed_at", "reliability_score"]


def time(x: str) -> Column:
    return F.lit(x).cast("timestamp_ntz")


def all_of(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        df = df if c is None else df.where(c)
    return df


def events_where(events: DataFrame, since: str | None = None, until: str | None = None, types: list[str] | None = None, state: str | None = None, district: str | None = None, statuses: list[str] | None = None, evidence: float | None = None, warnings: list[str] | None = None) -> DataFrame:
    """Events that overlap the time (updated since, started until) and are of these types, place, statuses, evidence and levels."""
    col, has = F.col, lambda x, f: None if x is None else f(x)
    return all_of(
        events, has(since, lambda x: col("last_updated") >= time(x)), has(until, lambda x: col("start_time") <= time(x)), has(types, lambda x: col("event_type").isin(x)), has(state, lambda x: col("state") == x),
        has(district, lambda x: col("district") == x), has(statuses, lambda x: col("status").isin(x)), has(evidence, lambda x: col("evidence_score") >= x), has(warnings, lambda x: col("warning_level").isin(x)),
    )


def reports_where(reports: DataFrame, event_id: int | None = None, raw_event_id: str | None = None, source_type: str | None = None, kind: str | None = None, state: str | None = None, district: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Reports by event, raw event, source, type, place, author and time, both ends included."""
    col, has = F.col, lambda x, f: None if x is None else f(x)
    same = {"event_id": event_id, "raw_event_id": raw_event_id, "source_type": source_type, "predicted_event_type": kind, "state": state, "district": district, "author": author}
    return all_of(reports, *(col(k) == v for k, v in same.items() if v is not None), has(since, lambda x: col("observed_at") >= time(x)), has(until, lambda x: col("observed_at") <= time(x)))


def tagged(df: DataFrame, tag: str, hashtags: str = "hashtags") -> DataFrame:
    """Rows whose lower-case hashtags hold tag, with or without its mark."""
    return df.where(F.array_contains(hashtags, tag.lstrip("#").lower()))


def in_box(df: DataFrame, south: float | None = None, west: float | None = None, north: float | None = None, east: float | None = None) -> DataFrame:
    """Located rows, whose coordinates are finite; within the box only where all four edges are given."""
    finite = lambda c: F.coalesce((F.abs(F.col(c)) < float("inf")) & ~F.isnan(c), F.lit(False))
    rows = df.where(finite("latitude") & finite("longitude"))
    if None in (south, west, north, east):
        return rows
    return rows.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def preset(column: str, name: str, as_of: str) -> Column:
    """A column lies in the last hours of a preset; `all` holds always."""
    hours = PRESETS[name]
    return F.lit(True) if hours is None else F.col(column) >= time(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def page(df: DataFrame, sort: str, id: str, descending: bool = True, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, total) of a page; columns with a vocabulary sort by its order, ties by id."""
    key = rank_of(F.col(sort), ORDERS[sort]) if sort in ORDERS else F.col(sort)
    return df.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last(), id).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def map_events(events: DataFrame, box: tuple = (None,) * 4, most: int = 5000, **filters) -> DataFrame:
    """The newest located events of the filters, for a map."""
    return in_box(events_where(events, **filters), *box).select(*MAP_EVENT).orderBy(F.desc("last_updated"), "event_id").limit(most)


def map_reports(reports: DataFrame, as_of: str, hours: int = 24, types: list[str] | None = None, box: tuple = (None,) * 4, most: int = 10_000) -> DataFrame:
    """The newest located originals of the last hours."""
    rows = in_box(reports.where("duplicate_of_report_id is null"), *box).where(F.col("observed_at") >= time(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    return all_of(rows, None if types is None else F.col("predicted_event_type").isin(types)).select(*MAP_REPORT).orderBy(F.desc("observed_at"), "report_id").limit(most)


def audit_where(audit: DataFrame, action: str | None = None, target_type: str | None = None) -> DataFrame:
    return all_of(audit, None if action is None else F.col("action") == action, None if target_type is None else F.col("target_type") == target_type)


def training_rows(reports: DataFrame, text: str = "text", label: str = "label", noise: str = "is_noise") -> DataFrame:
    """Distinct (text, label) that a classifier may learn from: labelled, longer than eight characters, no noise."""
    return reports.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 8) & ~F.coalesce(F.col(noise), F.lit(False))).select(F.col(text).alias("text"), F.col(label).alias("label")).distinct()


def samples(reports: DataFrame, n: int = 10) -> DataFrame:
    """The n reports of each event that say most: by reliability, those without one last, then the newest."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_id").orderBy(F.col("reliability_score").desc_nulls_last(), F.desc("observed_at"), "report_id")
    return reports.where("event_id is not null").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def outbox(deliveries: DataFrame, authorities: DataFrame, batch: int = 25) -> DataFrame:
    """The oldest pending deliveries of a batch, with the authority's name."""
    names = authorities.select("authority_id", F.col("name").alias("authority"))
    return deliveries.where("status = 'PENDING'").join(names, "authority_id", "left").orderBy("queued_at", "alert_id", "authority_id", "channel").limit(batch)
