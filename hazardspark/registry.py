"""The queries of the hazard-report operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark import fixtures as fx
from hazardspark import rules
from hazardspark.functions import text
from hazardspark.operators import analytics as a
from hazardspark.operators import scoring as s
from hazardspark.plans import browsing, lifecycle, places, reports  # noqa: F401  (they register their queries)
from hazardspark.plans.base import ORACLE, QUERIES, query  # noqa: F401

_TYPES = ", ".join(f"count_if({{0}} = '{t}') AS {t.lower()}" for t in rules.EVENT_TYPES)
_ZERO = ", ".join(f"coalesce(c.{t.lower()}, 0) AS {t.lower()}" for t in rules.EVENT_TYPES)


@query("fx_incidents", sql=f"""WITH p AS (SELECT state, event_type, count(*) n, sum(report_count) r, count_if(status = 'VERIFIED') v, sum(evidence_score) e FROM fx_incidents WHERE last_updated >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 8760 HOURS GROUP BY ALL)
SELECT state, CAST(sum(n) AS BIGINT) event_count, CAST(sum(r) AS BIGINT) report_count, CAST(sum(v) AS BIGINT) verified_count, round(sum(e) / sum(n), 6) avg_evidence, arg_min(event_type, (-n, event_type)) dominant_type FROM p GROUP BY state""")
def by_state(e):
    return a.by_state(e, fx.AS_OF, 8760)


@query("fx_incidents", sql="""SELECT count(*) total, count_if(status IN ('DETECTED','CORROBORATING','NEEDS_REVIEW')) AS open, count_if(status = 'VERIFIED') verified, count_if(status = 'NEEDS_REVIEW') needs_review, count_if(status = 'REJECTED') rejected, round(avg(evidence_score), 6) avg_evidence FROM fx_incidents""")
def event_summary(e):
    return a.event_summary(e)


@query("fx_reports", sql=f"""SELECT count(*) total, count_if(observed_at >= TIMESTAMP '{fx.REPORTS_AS_OF}' - INTERVAL 1 HOUR) last_hour, count(duplicate_of_report_id) duplicates, round(count(duplicate_of_report_id) / count(*), 4) dedup_rate FROM fx_reports""")
def report_summary(r):
    return a.report_summary(r, fx.REPORTS_AS_OF)


@query("fx_incidents", sql="SELECT v.value, CAST(v.ordinal AS INTEGER) AS ordinal, count(e.event_id) n FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in rules.EVENT_TYPES) + "]) AS value, generate_subscripts([1,2,3,4,5,6,7], 1) - 1 AS ordinal) v LEFT JOIN fx_incidents e ON e.event_type = v.value GROUP BY ALL")
def hazard_totals(e):
    return a.counts_over(e, "event_type", rules.EVENT_TYPES)


@query("fx_incidents", sql="SELECT v.value, CAST(v.ordinal AS INTEGER) AS ordinal, count(e.event_id) n FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in rules.EVENT_STATUSES) + "]) AS value, generate_subscripts([1,2,3,4,5,6], 1) - 1 AS ordinal) v LEFT JOIN fx_incidents e ON e.status = v.value GROUP BY ALL")
def stage_counts(e):
    return a.counts_over(e, "status", rules.EVENT_STATUSES)


@query("fx_reports", sql=f"""WITH b AS (SELECT CAST(floor((epoch_us(observed_at) - epoch_us(TIMESTAMP '{fx.REPORTS_AS_OF}' - INTERVAL 24 HOURS)) / 1800000000) AS INTEGER) bucket, predicted_event_type k FROM fx_reports WHERE duplicate_of_report_id IS NULL AND observed_at >= TIMESTAMP '{fx.REPORTS_AS_OF}' - INTERVAL 24 HOURS AND observed_at <= TIMESTAMP '{fx.REPORTS_AS_OF}'),
c AS (SELECT bucket, count(*) total, {_TYPES.format('k')} FROM b GROUP BY bucket)
SELECT CAST(g.i AS INTEGER) bucket, coalesce(c.total, 0) total, {_ZERO} FROM range(49) g(i) LEFT JOIN c ON c.bucket = g.i""")
def timeline_grid(r):
    return a.timeline(r, fx.REPORTS_AS_OF, 24, 30)


@query("fx_incidents", sql="SELECT min(start_time) first_event, max(start_time) last_event, count(*) n, date_sub('minute', min(start_time), max(start_time)) / 60.0::DOUBLE span_hours FROM fx_incidents")
def coverage_span(e):
    return a.coverage(e)


@query("fx_incidents", "fx_alerts", sql="""WITH t AS (SELECT state, district, event_type, count(*) n, sum(evidence_score) e, count_if(status = 'VERIFIED') v, count_if(status = 'REJECTED') r FROM fx_incidents GROUP BY ALL),
p AS (SELECT state, district, CAST(sum(n) AS BIGINT) events, CAST(sum(v) AS BIGINT) verified, CAST(sum(r) AS BIGINT) rejected, round(sum(e) / sum(n), 6) avg_evidence, arg_min(event_type, (-n, event_type)) dominant_hazard FROM t GROUP BY ALL),
b AS (SELECT state, district, count(*) alerts, count_if(level = 'RED') red_alerts FROM fx_alerts GROUP BY ALL)
SELECT p.*, coalesce(b.alerts, 0) alerts, coalesce(b.red_alerts, 0) red_alerts FROM p LEFT JOIN b ON p.state = b.state AND p.district = b.district""")
def preparedness_districts(e, al):
    return a.preparedness(e, al)


@query("fx_incidents", sql=f"""WITH c AS (SELECT hour(start_time + INTERVAL 330 MINUTES) h, {_TYPES.format('event_type')}, count(*) total FROM fx_incidents GROUP BY h)
SELECT CAST(g.i AS INTEGER) AS hour, {_ZERO}, coalesce(c.total, 0) total FROM range(24) g(i) LEFT JOIN c ON c.h = g.i""")
def hour_of_day(e):
    return a.hour_of_day(e)


@query("fx_incidents", sql="SELECT CAST(h AS INTEGER) peak_hour, n FROM (SELECT hour(start_time + INTERVAL 330 MINUTES) h, count(*) n FROM fx_incidents GROUP BY h ORDER BY n DESC, h LIMIT 1)")
def peak_hour(e):
    return a.hour_of_day(e).orderBy(F.desc("total"), "hour").limit(1).select(F.col("hour").alias("peak_hour"), F.col("total").alias("n"))


@query("fx_alerts", "fx_incidents", sql="""WITH l AS (SELECT date_diff('second', e.start_time, x.raised_at) / 60.0::DOUBLE m FROM fx_alerts x JOIN fx_incidents e USING (event_id))
SELECT count(*) n, quantile_cont(m, 0.5) median_minutes, quantile_cont(m, 0.9) p90_minutes FROM l WHERE m <= 180""")
def detection_lead(al, e):
    return a.detection_lead(al, e)


@query("fx_alerts", sql=f"SELECT count_if(status = 'ACTIVE') active, count_if(status = 'ACKNOWLEDGED') acknowledged, count_if(status = 'CLOSED') closed, date_sub('minute', min(raised_at) FILTER (status = 'ACTIVE'), TIMESTAMP '{fx.AS_OF}') oldest_active_minutes FROM fx_alerts")
def alert_summary(al):
    return a.alert_summary(al, fx.AS_OF)


@query("fx_alerts", sql="SELECT v.value, CAST(v.ordinal AS INTEGER) AS ordinal, count(e.alert_id) n FROM (SELECT unnest(['GREEN','YELLOW','ORANGE','RED']) AS value, generate_subscripts([1,2,3,4], 1) - 1 AS ordinal) v LEFT JOIN (SELECT * FROM fx_alerts WHERE status IN ('ACTIVE', 'ACKNOWLEDGED')) e ON e.level = v.value GROUP BY ALL")
def alerts_by_level(al):
    return a.counts_over(al.where("status in ('ACTIVE', 'ACKNOWLEDGED')"), "level", rules.WARNING_LEVELS)


@query("fx_incidents", sql="SELECT event_id, event_type, status, state, evidence_score FROM fx_incidents WHERE last_updated >= TIMESTAMP '2000-01-01' AND start_time <= TIMESTAMP '2001-01-01' AND event_type IN ('RAIN', 'FLOOD') AND evidence_score >= 0.5 ORDER BY evidence_score DESC, event_id LIMIT 50 OFFSET 50")
def events_filtered_page(e):
    rows = e.where((F.col("last_updated") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("start_time") <= F.lit("2001-01-01").cast("timestamp_ntz")) & F.col("event_type").isin("RAIN", "FLOOD") & (F.col("evidence_score") >= 0.5))
    return rows.select("event_id", "event_type", "status", "state", "evidence_score").orderBy(F.desc("evidence_score"), "event_id").offset(50).limit(50)


@query("fx_incidents", sql="SELECT event_id, event_type, state, evidence_score, last_updated FROM fx_incidents WHERE status = 'NEEDS_REVIEW' ORDER BY evidence_score, last_updated DESC, event_id LIMIT 100")
def review_queue(e):
    return e.where("status = 'NEEDS_REVIEW'").select("event_id", "event_type", "state", "evidence_score", "last_updated").orderBy("evidence_score", F.desc("last_updated"), "event_id").limit(100)


@query("fx_reports", sql="SELECT report_id, predicted_event_type, latitude, longitude, source_type FROM fx_reports WHERE latitude BETWEEN 10 AND 20 AND longitude BETWEEN 72 AND 79 AND duplicate_of_report_id IS NULL")
def map_bbox(r):
    return r.where("latitude between 10 and 20 and longitude between 72 and 79 and duplicate_of_report_id is null").select("report_id", "predicted_event_type", "latitude", "longitude", "source_type")


@query("fx_incidents", sql="""WITH w AS (SELECT *, CASE WHEN status IN ('REJECTED', 'RESOLVED') THEN true ELSE false END AS shut, CASE WHEN report_count >= 25 AND source_count >= 4 AND evidence_score >= 0.62 THEN 3 WHEN report_count >= 10 AND source_count >= 3 AND evidence_score >= 0.5 THEN 2 WHEN source_count >= 2 AND evidence_score >= 0.38 THEN 1 ELSE 0 END AS l0, flagged_report_count / report_count >= 0.5 AS much FROM fx_incidents),
x AS (SELECT *, CASE WHEN much AND l0 > 1 THEN 1 ELSE l0 END AS l1, much AND l0 > 1 AND NOT shut AS capped FROM w)
SELECT event_id, CASE WHEN report_count < 5 THEN 'LOW' WHEN report_count < 15 THEN 'MODERATE' WHEN report_count < 30 THEN 'HIGH' ELSE 'SEVERE' END AS severity,
CASE WHEN status NOT IN ('DETECTED','CORROBORATING','NEEDS_REVIEW') THEN status WHEN source_count >= 3 OR status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' WHEN source_count = 2 OR status = 'CORROBORATING' THEN 'CORROBORATING' ELSE 'DETECTED' END AS auto_status,
CASE CASE WHEN shut THEN 0 WHEN status = 'VERIFIED' THEN greatest(l1, 2) ELSE l1 END WHEN 3 THEN 'RED' WHEN 2 THEN 'ORANGE' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END AS warning_level, capped FROM x""")
def severity_status_warning(e):
    return s.warning_level(e).select("event_id", "severity", "auto_status", "warning_level", "capped")


_SUPPORT = """CASE WHEN predicted_event_type IN ('RAIN', 'FLOOD') THEN rain WHEN predicted_event_type = 'THUNDERSTORM' THEN greatest(rain, wind) WHEN predicted_event_type = 'HEATWAVE' THEN heat WHEN predicted_event_type = 'FOG' THEN fog WHEN predicted_event_type IN ('DUST_STORM', 'STRONG_WIND') THEN wind ELSE 0.5 END"""
_PARTS = """SELECT *, coalesce(least(greatest(precipitation_mm / 2, 0), 1), 0.5) rain, coalesce(least(greatest((temperature_c - 30) / 8, 0), 1), 0.5) heat, coalesce(least(greatest(wind_speed_kmh / 30, 0), 1), 0.5) wind, CASE WHEN visibility_m IS NOT NULL THEN least(greatest(1 - visibility_m / 10000, 0), 1) ELSE coalesce(least(greatest((humidity_pct - 60) / 30, 0), 1), 0.5) END fog FROM fx_reports"""


@query("fx_reports", sql=f"WITH p AS ({_PARTS}) SELECT report_id, round({_SUPPORT}, 4) AS support FROM p")
def support_scores(r):
    return r.select("report_id", s.support(F.col("predicted_event_type")).alias("support"))


@query("fx_reports", sql="SELECT report_id, CASE WHEN precipitation_mm >= 6 THEN 'FLOOD' WHEN precipitation_mm >= 1 THEN 'RAIN' WHEN temperature_c >= 38 THEN 'HEATWAVE' WHEN wind_speed_kmh >= 30 THEN 'STRONG_WIND' WHEN visibility_m < 2000 THEN 'FOG' WHEN humidity_pct >= 90 THEN 'FOG' WHEN humidity_pct >= 70 AND precipitation_mm > 0 THEN 'RAIN' END AS condition FROM fx_reports")
def dominant_condition(r):
    return r.select("report_id", s.dominant_condition().alias("condition"))


_NEAR = """n AS (SELECT x.report_id, count(DISTINCT y.source_id) nearby FROM fx_reports x JOIN fx_reports y ON x.predicted_event_type = y.predicted_event_type AND y.duplicate_of_report_id IS NULL AND (x.source_id IS NULL OR y.source_id <> x.source_id) AND (y.observed_at < x.observed_at OR (y.observed_at = x.observed_at AND y.report_id < x.report_id)) AND y.observed_at >= x.observed_at - INTERVAL 90 MINUTES
AND 2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(y.latitude - x.latitude) / 2), 2) + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2), 1))) <= 15000 WHERE x.duplicate_of_report_id IS NULL GROUP BY x.report_id)"""


@query("fx_reports", sql=f"WITH {_NEAR} SELECT r.report_id, coalesce(n.nearby, 0) nearby FROM fx_reports r LEFT JOIN n USING (report_id)")
def nearby_sources(r):
    return s.nearby_sources(r)


@query("fx_reports", sql=f"""WITH {_NEAR}, p AS ({_PARTS}), q AS (SELECT p.report_id, round(round(0.3 * CASE source_type WHEN 'GOVERNMENT' THEN 1.0::DOUBLE WHEN 'WEATHER_API' THEN 1.0 WHEN 'SATELLITE' THEN 0.9 WHEN 'WEB_RSS' THEN 0.7 WHEN 'CITIZEN' THEN 0.6 WHEN 'SOCIAL' THEN 0.5 ELSE 0.5 END + 0.3 * round({_SUPPORT}, 4) + 0.2 * least(coalesce(n.nearby, 0) / 5.0::DOUBLE, 1) + 0.2 * location_confidence + 1e-9, 4), 4) score FROM p LEFT JOIN n USING (report_id))
SELECT report_id, score FROM q""")
def reliability(r):
    rows = r.join(s.nearby_sources(r), "report_id").withColumn("support", s.support(F.col("predicted_event_type")))
    return s.reliability(rows).select("report_id", F.col("score"))


@query("fx_alerts", "fx_authorities", sql="""WITH r AS (SELECT *, CASE level WHEN 'RED' THEN 3 WHEN 'ORANGE' THEN 2 WHEN 'YELLOW' THEN 1 ELSE 0 END lr FROM fx_alerts)
SELECT r.alert_id, u.authority_id FROM r JOIN fx_authorities u ON u.status = 'ACTIVE' AND r.lr >= CASE u.min_level WHEN 'RED' THEN 3 ELSE 2 END AND (u.event_types_csv IS NULL OR list_contains(string_split(u.event_types_csv, ','), r.event_type))
AND (u.level = 'NATIONAL' OR (u.level = 'STATE' AND u.state = r.state) OR (u.level = 'DISTRICT' AND u.district = r.district AND (coalesce(u.state, '') = '' OR u.state = r.state)))""")
def alert_routing(al, u):
    return s.route(al, u)


_SILVER = "sv AS (SELECT *, collected_at + INTERVAL 330 MINUTES AS local FROM fx_reports)"


@query("fx_reports", sql=f"WITH {_SILVER} SELECT CAST(local AS DATE) AS day, source_type, count(*) documents, count(DISTINCT district) cities, count_if(is_noise) noise, count_if(has_media) media, round(count_if(is_noise) / count(*), 4) noise_rate FROM sv GROUP BY 1, 2")
def intake_daily(r):
    return a.intake_daily(a.intake(r))


@query("fx_reports", sql=f"WITH {_SILVER} SELECT CAST(hour(local) AS INTEGER) AS hour, count(*) documents FROM sv GROUP BY 1")
def intake_hourly(r):
    return a.intake_hourly(a.intake(r))


@query("fx_reports", sql="SELECT district AS city, count(*) documents, count(DISTINCT source_type) source_types FROM fx_reports WHERE district IS NOT NULL GROUP BY 1")
def intake_by_city(r):
    return a.intake_by_city(a.intake(r))


@query("fx_reports", sql="SELECT source_type, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_reports GROUP BY 1")
def source_share(r):
    return a.source_share(r)


@query("fx_incidents", sql="SELECT state, count(DISTINCT district) districts, string_agg(DISTINCT district, ',' ORDER BY district) AS names FROM fx_incidents GROUP BY 1")
def district_options(e):
    return a.district_options(e)


@query("fx_posts", sql=r"SELECT doc_id, hashtags FROM (SELECT doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') AS hashtags FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1), lambda v: lower(v)) x FROM fx_posts))")
def hashtags_extract(d):
    return d.select("doc_id", F.array_join(text.hashtags(F.col("text")), ",").alias("hashtags"))


@query("documents", sql=r"SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://\S+|www\.\S+)', ' ', 'g'), '[#@]([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g')))) AS text_hash FROM documents")
def content_hash(d):
    return d.select("doc_id", text.content_hash(F.col("text")).alias("text_hash"))


@query("fx_reports", sql="SELECT report_id, first_value(report_id) OVER (PARTITION BY source_id, external_id ORDER BY observed_at, report_id) AS original FROM fx_reports QUALIFY original <> report_id")
def external_id_duplicates(r):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id", "external_id").orderBy("observed_at", "report_id")
    return r.select("report_id", F.first("report_id").over(w).alias("original")).where("original <> report_id")
