"""Severity, status, warning level, support, reliability and nearby sources as columns and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark import rules


def rank_of(column: Column, vocabulary: list[str]) -> Column:
    """Place in the vocabulary, null for other values."""
    return F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)]), column)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def severity(reports: Column) -> Column:
    return reduce(lambda other, step: F.when(reports < step[0], step[1]).otherwise(other), reversed(rules.SEVERITY_STEPS), F.lit("SEVERE"))


def automatic_status(status: Column, sources: Column) -> Column:
    """Status by distinct sources; it only rises, and never touches what a person decided."""
    found = F.when(sources >= 3, 2).when(sources == 2, 1).otherwise(0)
    now = rank_of(status, rules.EVENT_STATUSES[:3])
    return F.when(now.isNull(), status).otherwise(F.element_at(F.array(*map(F.lit, rules.EVENT_STATUSES[:3])), F.greatest(found, now) + 1))


def warning_level(events: DataFrame) -> DataFrame:
    """severity, auto_status, warning_level and capped: many flagged reports cap at YELLOW, verification then lifts to ORANGE."""
    level = F.lit(0)
    for name, reports, sources, evidence in reversed(rules.WARNING_STEPS):
        level = F.when((F.col("report_count") >= reports) & (F.col("source_count") >= sources) & (F.col("evidence_score") >= evidence), rules.WARNING_LEVELS.index(name)).otherwise(level)
    flagged = F.when(F.col("report_count") > 0, F.col("flagged_report_count") / F.col("report_count")).otherwise(0.0)
    capped = (flagged >= rules.FLAGGED_CAP) & (level > 1)
    level = F.when(capped, 1).otherwise(level)
    level = F.when(F.col("status") == "VERIFIED", F.greatest(level, F.lit(2))).otherwise(level)
    level = F.when(F.col("status").isin("REJECTED", "RESOLVED"), 0).otherwise(level)
    return (
        events.withColumn("severity", severity(F.col("report_count")))
        .withColumn("auto_status", automatic_status(F.col("status"), F.col("source_count")))
        .withColumn("warning_level", F.element_at(F.array(*map(F.lit, rules.WARNING_LEVELS)), level + 1))
        .withColumn("capped", capped & ~F.col("status").isin("REJECTED", "RESOLVED"))
    )


def support(kind: Column) -> Column:
    """How far an observation speaks for a type, 0 to 1; 0.5 where the reading is missing or the type is not known."""
    half = lambda x: F.coalesce(clamp(x), F.lit(0.5))
    rain = half(F.col("precipitation_mm") / 2)
    heat, wind = half((F.col("temperature_c") - 30) / 8), half(F.col("wind_speed_kmh") / 30)
    fog = F.when(F.col("visibility_m").isNotNull(), clamp(1 - F.col("visibility_m") / 10000)).otherwise(half((F.col("humidity_pct") - 60) / 30))
    return F.round(F.when(kind.isin("RAIN", "FLOOD"), rain).when(kind == "THUNDERSTORM", F.greatest(rain, wind)).when(kind == "HEATWAVE", heat).when(kind == "FOG", fog).when(kind.isin("DUST_STORM", "STRONG_WIND"), wind).otherwise(0.5), 4)


def dominant_condition() -> Column:
    """The first that holds of an ordered list of conditions, else null."""
    p, t, w, v, h = (F.col(x) for x in ("precipitation_mm", "temperature_c", "wind_speed_kmh", "visibility_m", "humidity_pct"))
    return (
        F.when(p >= 6, "FLOOD").when(p >= 1, "RAIN").when(t >= 38, "HEATWAVE").when(w >= 30, "STRONG_WIND").when(v < 2000, "FOG").when(h >= 90, "FOG").when((h >= 70) & (p > 0), "RAIN")
    )


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * rules.EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bands(radius_m: float) -> float:
    """Height of a band of latitude, a little above the radius."""
    return radius_m / 111_000 * 1.01


def across(band: Column, step: float) -> Column:
    """Cells of a band: each as wide as the radius where the band, and the band beside it, is narrowest."""
    edge = F.least((F.abs(band + 0.5) + 1.5) * step, F.lit(90.0))
    return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / step), F.lit(1)).cast("long")


def cell(lat: Column, lon: Column, radius_m: float) -> Column:
    """The (band, cell) of a point."""
    step = bands(radius_m)
    band = F.floor(lat / step)
    n = across(band, step)
    return F.struct(band.alias("cy"), F.pmod(F.floor((lon + 180) / 360 * n), n).alias("cx"))


def cells_around(lat: Column, lon: Column, radius_m: float) -> Column:
    """All cells that hold points within the radius of a point, each once: at any latitude, and across the 180th meridian."""
    step = bands(radius_m)

    def of(dy):
        band = F.floor(lat / step) + dy
        n = across(band, step)
        return F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda dx: F.struct(band.alias("cy"), F.pmod(F.floor((lon + 180) / 360 * n) + dx, n).alias("cx")))

    return F.array_distinct(F.concat(of(-1), of(0), of(1)))


def wide_cells_around(lat: Column, lon: Column, radius_m: float) -> Column:
    """The cells for twice the radius that hold points within the radius of a point, each once: four mostly, where cells_around has nine."""
    step, reach = bands(2 * radius_m), bands(radius_m)

    def of(dy):
        band = F.floor(lat / step) + dy
        n = across(band, step)
        return F.transform(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), lambda dx: F.struct(band.alias("cy"), F.pmod(F.floor((lon + 180) / 360 * n + dx), n).alias("cx")))

    touched = lambda x: x.cy.between(F.floor((lat - reach) / step), F.floor((lat + reach) / step))
    return F.array_distinct(F.filter(F.concat(of(-1), of(0), of(1)), touched))


def nearby_sources(reports: DataFrame, radius_m: float = 15000, minutes: int = 90) -> DataFrame:
    """(report_id, nearby): other sources with an earlier original report of the type, near in space and time.

    An equi-join on type, a grid cell and a time bucket, each probe copied to the cells around it, so neither a
    nested loop nor a whole type meets in one task; the distance is the residual. To a report without a source all sources are others.
    """
    rows = reports.where("latitude is not null and longitude is not null and duplicate_of_report_id is null").select(
        "report_id", "source_id", F.col("predicted_event_type").alias("kind"), "latitude", "longitude", F.unix_seconds(F.col("observed_at").cast("timestamp")).alias("t"),
    )
    at = lambda d: d.withColumn("ct", F.floor(F.col("t") / (minutes * 60)))
    other = at(rows).withColumn("cell", cell(F.col("latitude"), F.col("longitude"), radius_m)).select("kind", "cell", "ct", *(F.col(x).alias(f"o_{x}") for x in ("report_id", "source_id", "latitude", "longitude", "t")))
    probe = at(rows).withColumn("cell", F.explode(cells_around(F.col("latitude"), F.col("longitude"), radius_m))).withColumn("ct", F.explode(F.array(F.col("ct") - 1, F.col("ct"))))
    earlier = (F.col("o_t") < F.col("t")) | ((F.col("o_t") == F.col("t")) & (F.col("o_report_id") < F.col("report_id")))
    near = metres(F.col("latitude"), F.col("longitude"), F.col("o_latitude"), F.col("o_longitude")) <= radius_m
    apart = F.col("source_id").isNull() | (F.col("o_source_id") != F.col("source_id"))
    met = probe.join(other, ["kind", "cell", "ct"]).where(earlier & (F.col("o_t") >= F.col("t") - minutes * 60) & apart & near)
    found = met.groupBy("report_id").agg(F.count_distinct("o_source_id").alias("nearby"))
    return reports.select("report_id").join(found, "report_id", "left").na.fill(0, ["nearby"])


def reliability(reports: DataFrame) -> DataFrame:
    """score of trust, weather support, nearby sources and location, and its band. Halves round up, whatever the last bit of the sum."""
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.SOURCE_TRUST.items() for x in kv]), F.col("source_type")), F.lit(rules.UNKNOWN_TRUST))
    score = 0.30 * trust + 0.30 * F.col("support") + 0.20 * F.least(F.col("nearby") / 5, F.lit(1.0)) + 0.20 * clamp(F.col("location_confidence"))
    band = F.when(F.col("score") >= 0.75, "VERIFIABLE").when(F.col("score") >= 0.40, "NEEDS_REVIEW").otherwise("INSUFFICIENT_EVIDENCE")
    return reports.withColumn("score", F.round(score + 1e-9, 4)).withColumn("band", band)


def route(alerts: DataFrame, authorities: DataFrame, salts: int = 16, of_alert: list[str] = ["alert_id"], of_authority: list[str] = ["authority_id"]) -> DataFrame:  # noqa: B006
    """(alert_id, authority_id): active authorities whose level, area and subscription cover the alert.

    of_alert, of_authority: the columns given, where more should go along or ids aren't needed. Pairs grow with the product of both tables, so a later join to either is dear.

    One equi-join on the area and the rank of the alert: an alert asks for the nation, its state and its
    district, an authority answers for every rank from its least. The nation is one area, so its rows are dealt by a salt.
    """
    ranks = lambda c: rank_of(F.col(c), rules.WARNING_LEVELS)
    top = len(rules.WARNING_LEVELS) - 1
    reach = F.when(F.col("level") == "NATIONAL", F.struct(F.lit("NATIONAL").alias("reach"), F.lit("").alias("area"))).when(F.col("level") == "STATE", F.struct(F.lit("STATE").alias("reach"), F.col("state").alias("area"))).when(
        F.col("level") == "DISTRICT", F.struct(F.lit("DISTRICT").alias("reach"), F.col("district").alias("area"))
    )
    who = authorities.where("status = 'ACTIVE'").select(F.struct(*of_authority).alias("u"), reach.alias("r"), F.col("state").alias("a_state"), F.split("event_types_csv", ",").alias("types"), F.explode(F.sequence(ranks("min_level"), F.lit(top))).alias("rank"))
    who = who.select("u", "r.reach", "r.area", "a_state", "types", "rank", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).where("area is not null")
    asks = F.array(*[F.struct(F.lit(k).alias("reach"), x.alias("area")) for k, x in (("NATIONAL", F.lit("")), ("STATE", F.col("state")), ("DISTRICT", F.col("district")))])
    what = alerts.select(F.struct(*of_alert).alias("a"), "event_type", "state", ranks("level").alias("rank"), F.pmod(F.xxhash64(*of_alert), F.lit(salts)).cast("int").alias("salt"), F.inline(asks)).where("area is not null and rank is not null")
    takes = F.col("types").isNull() | F.array_contains("types", F.col("event_type"))
    own = (F.col("reach") != "DISTRICT") | (F.coalesce("a_state", F.lit("")) == "") | (F.col("state") == F.col("a_state"))
    return what.join(who, ["reach", "area", "rank", "salt"]).where(takes & own).select(*(F.col(f"a.{c}") for c in of_alert), *(F.col(f"u.{c}") for c in of_authority))
