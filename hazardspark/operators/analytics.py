"""Rollups over reports, events and alerts. as_of is a parameter; no wall clock is read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import rules
from hazardspark.storage import Scratch


def since(column: str, as_of: str, hours: int) -> Column:
    """column lies in the last hours before as_of."""
    return F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def top_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def by_state(events: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Events, reports, verified events, mean evidence and the dominant type of each state, of events updated lately.

    One pass by (state, type): the totals of a state and its dominant type come from the same small aggregate.
    """
    parts = events.where(since("last_updated", as_of, hours)).groupBy("state", "event_type").agg(
        F.count("*").alias("n"), F.sum("report_count").alias("reports"), F.count_if(F.col("status") == "VERIFIED").alias("verified"), F.sum("evidence_score").alias("evidence")
    )
    return parts.groupBy("state").agg(
        F.sum("n").alias("event_count"),
        F.sum("reports").alias("report_count"),
        F.sum("verified").alias("verified_count"),
        F.round(F.sum("evidence") / F.sum("n"), 6).alias("avg_evidence"),
        F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("dominant_type"),
    )


def event_summary(events: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("DETECTED", "CORROBORATING", "NEEDS_REVIEW")).alias("open"),
        is_("VERIFIED").alias("verified"), is_("NEEDS_REVIEW").alias("needs_review"), is_("REJECTED").alias("rejected"), F.round(F.avg("evidence_score"), 6).alias("avg_evidence"),
    )


def report_summary(reports: DataFrame, as_of: str) -> DataFrame:
    got = reports.agg(F.count("*").alias("total"), F.count_if(since("observed_at", as_of, 1)).alias("last_hour"), F.count("duplicate_of_report_id").alias("duplicates"))
    return got.withColumn("dedup_rate", F.round(rate(F.col("duplicates"), F.col("total")), 4))


def counts_over(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(value, n) for each word of the vocabulary, zero where it doesn't occur."""
    words = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "value string, ordinal int")
    found = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return words.join(found, "value", "left").select("value", "ordinal", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def timeline(reports: DataFrame, as_of: str, hours: int, minutes: int) -> DataFrame:
    """Reports by bucket and type since as_of - hours: every bucket is there, originals only, a column for each type."""
    anchor = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    bucket = F.floor((F.unix_micros(F.col("observed_at").cast("timestamp")) - F.unix_micros(anchor.cast("timestamp"))) / F.lit(minutes * 60_000_000)).cast("int")
    rows = reports.where(since("observed_at", as_of, hours) & F.col("duplicate_of_report_id").isNull() & (F.col("observed_at") <= F.lit(as_of).cast("timestamp_ntz")))
    counts = rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("total"), *(F.count_if(F.col("predicted_event_type") == t).alias(t.lower()) for t in rules.EVENT_TYPES))
    grid = reports.sparkSession.range(hours * 60 // minutes + 1).select(F.col("id").cast("int").alias("bucket"))
    return grid.join(counts, "bucket", "left").na.fill(0)


def coverage(events: DataFrame) -> DataFrame:
    lo, hi = F.min("start_time"), F.max("start_time")
    return events.agg(lo.alias("first_event"), hi.alias("last_event"), F.count("*").alias("n"), (F.timestamp_diff("MINUTE", lo, hi) / F.lit(60.0)).alias("span_hours"))


def preparedness(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """District profiles beside their alert burden; a district is named by state and district."""
    keys = ["state", "district"]
    by_type = events.groupBy(*keys, "event_type").agg(
        F.count("*").alias("n"), F.sum("evidence_score").alias("e"), F.count_if(F.col("status") == "VERIFIED").alias("v"), F.count_if(F.col("status") == "REJECTED").alias("r")
    )
    profile = by_type.groupBy(*keys).agg(
        F.sum("n").alias("events"), F.sum("v").alias("verified"), F.sum("r").alias("rejected"), F.round(F.sum("e") / F.sum("n"), 6).alias("avg_evidence"),
        F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("dominant_hazard"),
    )
    burden = alerts.groupBy(*keys).agg(F.count("*").alias("alerts"), F.count_if(F.col("level") == "RED").alias("red_alerts"))
    return profile.join(burden, keys, "left").na.fill(0, ["alerts", "red_alerts"])


def hour_of_day(events: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """24 local hours by type, zero where nothing happened. The session's zone must be UTC."""
    local = F.hour(F.from_utc_timestamp(F.col("start_time").cast("timestamp"), zone))
    counts = events.groupBy(local.alias("hour")).agg(*(F.count_if(F.col("event_type") == t).alias(t.lower()) for t in rules.EVENT_TYPES), F.count("*").alias("total"))
    return events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").na.fill(0)


def _at_ranks(rows: DataFrame, ranks: list[int], few: int, buckets: int) -> dict[int, float]:
    """The values at these ranks of rows(v): a histogram says which bucket holds a rank, and its rows are asked again until few are left or all are equal."""
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= few:
        values = sorted(r[0] for r in rows.collect())
        return {k: values[k] for k in ranks}
    place = F.least(F.floor((F.col("v") - low) / (high - low) * buckets), F.lit(buckets - 1)).cast("int")
    out, before = {}, 0
    for bucket, many in sorted(map(tuple, rows.groupBy(place.alias("bucket")).count().collect())):  # at most `buckets` rows
        own = [k - before for k in ranks if before <= k < before + many]
        if own:
            out |= {k + before: v for k, v in _at_ranks(rows.where(place == bucket), own, few, buckets).items()}
        before += many
    return out


def exact_quantiles(df: DataFrame, value: Column, at: list[float], few: int = 10_000, buckets: int = 1024) -> tuple[int, list[float | None]]:
    """(n, quantiles) of the finite values of a column, between the two nearest ranks in proportion; no value of all the others is sorted or sent.

    Each pass over the values narrows the range that holds a rank about `buckets` times, so passes follow the logarithm of the range over the gaps near the rank. Null and non-finite values are left out; without values the quantiles are null.
    """
    with Scratch(df.sparkSession) as scratch:
        v = F.col("v")
        rows = scratch.stored(df.select((value.cast("double") + 0.0).alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        n = rows.count()
        if not n:
            return 0, [None] * len(at)
        places = [p * (n - 1) for p in at]
        found = _at_ranks(rows, sorted({k for x in places for k in (math.floor(x), math.ceil(x))}), few, buckets)
        between = lambda x: found[math.floor(x)] if math.floor(x) == math.ceil(x) else (math.ceil(x) - x) * found[math.floor(x)] + (x - math.floor(x)) * found[math.ceil(x)]
        return n, [between(x) for x in places]


def detection_lead(alerts: DataFrame, events: DataFrame, most: int = 180) -> DataFrame:
    """Minutes from an event's start to its alert, where at most `most`: count, exact median and 90th percentile."""
    lead = F.timestamp_diff("SECOND", F.col("start_time"), F.col("raised_at")) / F.lit(60.0)
    rows = alerts.select("event_id", "raised_at").join(events.select("event_id", "start_time"), "event_id").select(lead.alias("lead")).where(F.col("lead") <= most)
    n, (median, late) = exact_quantiles(rows, F.col("lead"), [0.5, 0.9])
    return alerts.sparkSession.createDataFrame([(n, median, late)], "n long, median_minutes double, p90_minutes double")


def alert_summary(alerts: DataFrame, as_of: str) -> DataFrame:
    age = F.timestamp_diff("MINUTE", F.min(F.when(F.col("status") == "ACTIVE", F.col("raised_at"))), F.lit(as_of).cast("timestamp_ntz"))
    return alerts.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in rules.ALERT_STATUSES), age.cast("long").alias("oldest_active_minutes"))


def intake(reports: DataFrame) -> DataFrame:
    """The silver projection: local day and hour, noise and media as plain booleans."""
    local = F.from_utc_timestamp(F.col("collected_at").cast("timestamp"), "Asia/Kolkata")
    return reports.select("report_id", "source_type", local.cast("date").alias("day"), F.hour(local).alias("hour"), F.col("district").alias("city"), F.coalesce("is_noise", F.lit(False)).alias("is_noise"), "has_media")


def intake_daily(silver: DataFrame) -> DataFrame:
    got = silver.groupBy("day", "source_type").agg(F.count("*").alias("documents"), F.count_distinct("city").alias("cities"), F.count_if("is_noise").alias("noise"), F.count_if("has_media").alias("media"))
    return got.withColumn("noise_rate", F.round(rate(F.col("noise"), F.col("documents")), 4))


def intake_hourly(silver: DataFrame) -> DataFrame:
    return silver.groupBy("hour").agg(F.count("*").alias("documents"))


def intake_by_city(silver: DataFrame) -> DataFrame:
    return silver.where("city is not null").groupBy("city").agg(F.count("*").alias("documents"), F.count_distinct("source_type").alias("source_types"))


def source_share(reports: DataFrame) -> DataFrame:
    got = reports.groupBy("source_type").agg(F.count("*").alias("n"))
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a source type


def district_options(events: DataFrame) -> DataFrame:
    return events.select("state", "district").distinct().groupBy("state").agg(F.count("*").alias("districts"), F.array_join(F.sort_array(F.collect_set("district")), ",").alias("names"))
