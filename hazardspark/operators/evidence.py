"""What stands behind an event: counts, kinds of sources, flags, tags and contributors of its reports; health of sources and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import rules
from hazardspark.operators.analytics import counts_over, rate


def breakdown(reports: DataFrame) -> DataFrame:
    """One row an event of reports(event_id, source_id, source_type, reliability_score, support, duplicate_of_report_id, has_media, risk). Support without a reading is 0.5, scores without one 0."""
    score = lambda c, none: F.round(F.coalesce(F.avg(c), F.lit(none)), 4)
    return reports.where("event_id is not null").groupBy("event_id").agg(
        F.count("*").alias("report_count"), F.count_distinct("source_id").alias("source_count"), F.array_join(F.sort_array(F.collect_set("source_type")), ",").alias("source_types"), score("reliability_score", 0.0).alias("evidence_score"),
        score("support", 0.5).alias("weather_corroboration"), F.count("duplicate_of_report_id").alias("duplicate_count"), F.count_if("has_media").alias("with_media"), F.count_if(F.col("source_type") == "CITIZEN").alias("citizen_reports"),
        F.count_if(F.col("risk") >= rules.REVIEW_RISK).alias("flagged_count"), score("risk", 0.0).alias("avg_risk"),
    )


def top_items(reports: DataFrame, items: str, n: int) -> DataFrame:
    """(event_id, item, reports, nth): the n items of an array column that most reports of an event have."""
    by = reports.where("event_id is not null").select("event_id", F.explode(F.array_distinct(F.col(items))).alias("item")).groupBy("event_id", "item").agg(F.count("*").alias("reports"))
    w = Window.partitionBy("event_id").orderBy(F.desc("reports"), "item")
    return by.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def contributors(reports: DataFrame, sources: DataFrame, n: int = 6) -> DataFrame:
    """(event_id, name, source_type, reports, avg_score): the sources with most reports; one that isn't registered has that for a name."""
    rows = reports.where("event_id is not null").join(sources.select("source_id", "name"), "source_id", "left").withColumn("name", F.coalesce("name", F.lit("Unregistered")))
    by = rows.groupBy("event_id", "name", "source_type").agg(F.count("*").alias("reports"), F.round(F.coalesce(F.avg("reliability_score"), F.lit(0.0)), 4).alias("avg_score"))
    w = Window.partitionBy("event_id").orderBy(F.desc("reports"), "name", "source_type")
    return by.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def source_health(sources: DataFrame, raw: DataFrame, reports: DataFrame) -> DataFrame:
    """Every source with its raw documents and its reports, 0 where it has none."""
    count = lambda d, name: d.groupBy("source_id").agg(F.count("*").alias(name))
    return sources.join(count(raw, "raw_total"), "source_id", "left").join(count(reports, "reports"), "source_id", "left").na.fill(0, ["raw_total", "reports"])


def stage_health(reports: DataFrame, most: float = 0.10) -> DataFrame:
    """(value, ordinal, n, error_rate, degraded): processing states in their order; degraded where more than `most` failed."""
    by = counts_over(reports, "processing_state", rules.PIPELINE_STATES)
    whole = by.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("value") == "FAILED", F.col("n")).otherwise(0)).alias("failed"))  # one row
    share = rate(F.col("failed"), F.col("total"))
    return by.join(F.broadcast(whole)).select("value", "ordinal", "n", F.round(share, 4).alias("error_rate"), (share > most).alias("degraded"))


def load_report(metrics: DataFrame) -> DataFrame:
    """(stage, runs, errors, mean_ms, p50_ms, p95_ms, share) of metrics(stage, ms, ok): share is the stage's part of all time."""
    by = metrics.groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("errors"), F.avg("ms").alias("mean"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"), F.sum("ms").alias("all"))
    return by.select("stage", "runs", "errors", F.round("mean", 3).alias("mean_ms"), "p50_ms", "p95_ms", F.round(F.col("all") / F.sum("all").over(Window.partitionBy()), 4).alias("share"))  # one row a stage


def hit_rate(rows: DataFrame, key: str) -> DataFrame:
    """How many rows found what they looked up: (found, total, rate)."""
    got = rows.agg(F.count(key).alias("found"), F.count("*").alias("total"))
    return got.withColumn("rate", F.round(rate(F.col("found"), F.col("total")), 4))


def intake_coverage(hourly: DataFrame) -> DataFrame:
    """Of 24 hours those with documents, and the busiest one."""
    return hourly.agg(F.count_if(F.col("documents") > 0).alias("hours_covered"), F.min_by("hour", F.struct(-F.col("documents"), F.col("hour"))).alias("busiest_hour"))
