"""Queries over reports and texts: classification, credibility, weather, duplicates, clusters, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import fixtures as fx
from hazardspark import rules
from hazardspark.functions import text
from hazardspark.operators import clustering, intake, models
from hazardspark.operators import credibility as c
from hazardspark.operators import scoring as s
from hazardspark.plans.base import query

_HITS = {k: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) for k, words in rules.KEYWORDS.items()}
_KINDS = list(rules.KEYWORDS)
_CLASSIFIED = f"""h AS (SELECT *, {', '.join(f'{x} AS h_{k.lower()}' for k, x in _HITS.items())} FROM (SELECT *, lower(coalesce(text, '')) t FROM fx_posts)),
k AS (SELECT *, {' + '.join(f'h_{k.lower()}' for k in _KINDS)} AS total, greatest({', '.join(f'h_{k.lower()}' for k in _KINDS)}) AS most FROM h)"""
_PREDICTED = "CASE " + " ".join(f"WHEN total = 0 OR h_{k.lower()} = most THEN '{k}'" for k in _KINDS) + " END"


@query("fx_posts", sql=f"WITH {_CLASSIFIED} SELECT doc_id, CAST(total AS BIGINT) hits, {_PREDICTED} AS predicted, total > 0 AS has_signal FROM k")
def keyword_scores(d: DataFrame) -> DataFrame:
    return text.classified(d).select("doc_id", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x).alias("hits"), "predicted", "has_signal")


@query("documents", sql=r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://\S+|www\.\S+)', ' ', 'g'), '[#@]([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g'))) AS normalized FROM documents")
def text_normalize(d: DataFrame) -> DataFrame:
    return d.select("doc_id", text.normalized(F.col("text")).alias("normalized"))


@query("pages", sql=r"SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)(https?://\S+|www\.\S+)', 1), ' ') AS urls, array_to_string(list_transform(regexp_extract_all(html, '@([\p{L}\p{N}_]+)', 1), lambda x: lower(x)), ' ') AS mentions FROM pages")
def url_mentions(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.array_join(text.urls(F.col("html")), " ").alias("urls"), F.array_join(text.mentions(F.col("html")), " ").alias("mentions"))


@query("documents", sql=r"SELECT doc_id, CASE WHEN c BETWEEN 2304 AND 2431 THEN 'hi' WHEN c BETWEEN 2432 AND 2559 THEN 'bn' WHEN c BETWEEN 2688 AND 2815 THEN 'gu' WHEN c BETWEEN 2944 AND 3071 THEN 'ta' ELSE 'en' END AS language FROM (SELECT doc_id, CASE WHEN x <> '' THEN unicode(x) END c FROM (SELECT doc_id, regexp_extract(text, '([\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A80}-\x{0AFF}\x{0B80}-\x{0BFF}])', 1) x FROM documents))")
def language_by_script(d: DataFrame) -> DataFrame:
    return d.select("doc_id", text.script_language(F.col("text")).alias("language"))


_TAGS = r"t AS (SELECT DISTINCT doc_id, lang, unnest(list_transform(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1), lambda x: lower(x))) AS tag FROM fx_posts)"


@query("fx_posts", sql=f"WITH {_TAGS}, n AS (SELECT tag, lang, count(*) n FROM t GROUP BY ALL) SELECT tag, CAST(sum(n) AS BIGINT) n, arg_min(lang, (-n, lang)) dominant, list_contains([{', '.join(repr(x) for x in rules.TRACKED_HASHTAGS)}], tag) AS tracked FROM n WHERE lang IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 100")
def hashtag_ranking(d: DataFrame) -> DataFrame:
    tags = d.select("lang", F.explode(text.hashtags(F.col("text"))).alias("tag")).where("lang is not null")
    by = tags.groupBy("tag", "lang").agg(F.count("*").alias("n"))
    top = by.groupBy("tag").agg(F.sum("n").alias("total"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("dominant"))
    return top.select("tag", F.col("total").alias("n"), "dominant", F.col("tag").isin(rules.TRACKED_HASHTAGS).alias("tracked")).orderBy(F.desc("n"), "tag").limit(100)


_AGAINST = """coalesce(CASE WHEN predicted_event_type IN ('RAIN', 'FLOOD') THEN precipitation_mm = 0 AND humidity_pct < 55 WHEN predicted_event_type = 'THUNDERSTORM' THEN precipitation_mm = 0 AND humidity_pct < 55 AND wind_speed_kmh < 10
WHEN predicted_event_type = 'HEATWAVE' THEN temperature_c < 30 WHEN predicted_event_type = 'FOG' THEN CASE WHEN visibility_m IS NOT NULL THEN visibility_m > 8000 ELSE humidity_pct < 50 END ELSE wind_speed_kmh < 10 END, false)"""


@query("fx_reports", sql=f"SELECT report_id, {_AGAINST} AS contradicted FROM fx_reports")
def contradictions(r: DataFrame) -> DataFrame:
    return r.select("report_id", c.contradicted(F.col("predicted_event_type")).alias("contradicted"))


def assessed(r: DataFrame) -> DataFrame:
    """Reports with support, nearby, score, flags, risk. The type's own words are not asked: is_noise stands for no signal."""
    rows = r.join(s.nearby_sources(r), "report_id").withColumn("support", s.support(F.col("predicted_event_type")))
    rows = rows.withColumn("contradicted", c.contradicted(F.col("predicted_event_type"))).withColumn("observed", F.col("latitude").isNotNull())
    return c.credibility(s.reliability(rows.withColumn("has_signal", ~F.col("is_noise")).withColumn("is_duplicate", F.col("duplicate_of_report_id").isNotNull())))


_NEAR = """n AS (SELECT x.report_id, count(DISTINCT y.source_id) nearby FROM fx_reports x JOIN fx_reports y ON x.predicted_event_type = y.predicted_event_type AND y.duplicate_of_report_id IS NULL AND y.source_id <> x.source_id AND (y.observed_at < x.observed_at OR (y.observed_at = x.observed_at AND y.report_id < x.report_id)) AND y.observed_at >= x.observed_at - INTERVAL 90 MINUTES
AND 2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(y.latitude - x.latitude) / 2), 2) + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2), 1))) <= 15000 WHERE x.duplicate_of_report_id IS NULL GROUP BY x.report_id)"""
_FLAGS = f"""f AS (SELECT r.report_id, r.location_confidence, list_filter([CASE WHEN {_AGAINST} AND latitude IS NOT NULL AND location_confidence > 0.35 THEN 'CONTRADICTED_BY_OBSERVATION' END, CASE WHEN coalesce(n.nearby, 0) = 0 THEN 'UNCORROBORATED' END,
CASE WHEN source_type = 'SOCIAL' THEN 'LOW_TRUST_SOURCE' END, CASE WHEN location_confidence <= 0.35 THEN 'UNRESOLVED_LOCATION' END, CASE WHEN is_noise THEN 'NO_WEATHER_SIGNAL' END, CASE WHEN duplicate_of_report_id IS NOT NULL THEN 'DUPLICATE_CONTENT' END], lambda x: x IS NOT NULL) AS flags FROM fx_reports r LEFT JOIN n USING (report_id)),
w AS (SELECT *, round(least(list_sum(list_transform(list_concat([''], flags), lambda x: CASE x WHEN 'CONTRADICTED_BY_OBSERVATION' THEN 0.4::DOUBLE WHEN 'UNCORROBORATED' THEN 0.2 WHEN 'LOW_TRUST_SOURCE' THEN 0.15 WHEN 'NO_WEATHER_SIGNAL' THEN 0.25 WHEN '' THEN 0 ELSE 0.1 END)), 1), 4) AS risk FROM f)"""


@query("fx_reports", sql=f"WITH {_NEAR}, {_FLAGS} SELECT report_id, array_to_string(flags, ',') AS flags, risk, risk >= 0.5 AS needs_review FROM w")
def credibility(r: DataFrame) -> DataFrame:
    return assessed(r).select("report_id", F.array_join("flags", ",").alias("flags"), "risk", "needs_review")


@query("fx_reports", sql=f"WITH {_NEAR}, {_FLAGS}, a AS (SELECT count(*) total, count_if(risk >= 0.5) flagged, round(avg(risk), 6) avg_risk FROM w) SELECT v.flag, (SELECT count(*) FROM w WHERE list_contains(w.flags, v.flag)) n, a.* FROM (SELECT unnest([{', '.join(repr(x) for x in rules.FLAG_WEIGHTS)}]) AS flag) v, a")
def credibility_rollup(r: DataFrame) -> DataFrame:
    return c.rollup(assessed(r))


@query("fx_reports", sql=f"WITH {_NEAR}, {_FLAGS} SELECT report_id, list_contains(flags, 'CONTRADICTED_BY_OBSERVATION') AND location_confidence <= 0.45 AS released FROM w")
def backfill_credibility(r: DataFrame) -> DataFrame:
    """As if a location had counted as coarse up to 0.45."""
    return c.release_contradictions(assessed(r), 0.45).select("report_id", "released")


@query("fx_reports", sql="""WITH o AS (SELECT DISTINCT district, date_trunc('hour', observed_at) AS obs_time FROM fx_reports WHERE precipitation_mm IS NOT NULL),
g AS (SELECT r.report_id, o.obs_time, abs(epoch(r.observed_at) - epoch(o.obs_time)) gap_s, row_number() OVER (PARTITION BY r.report_id ORDER BY abs(epoch(r.observed_at) - epoch(o.obs_time)), o.obs_time) rn FROM fx_reports r JOIN o USING (district) WHERE abs(epoch(r.observed_at) - epoch(o.obs_time)) <= 86400)
SELECT report_id, obs_time, CAST(gap_s AS BIGINT) gap_s FROM g WHERE rn = 1""")
def weather_asof(r: DataFrame) -> DataFrame:
    hourly = r.where("precipitation_mm is not null").select("district", F.date_trunc("hour", "observed_at").cast("timestamp_ntz").alias("time")).distinct()
    return c.nearest_observation(r, hourly, "district")


@query("fx_reports", sql="SELECT report_id, CASE WHEN precipitation_mm >= 2 THEN 'Observed rainfall ' || printf('%.1f', precipitation_mm) || 'mm/h at ' || district || ' station' WHEN temperature_c >= 38 THEN 'Observed temperature ' || printf('%.1f', temperature_c) || 'C at ' || district || ' station, heatwave threshold crossed' WHEN wind_speed_kmh >= 30 THEN 'Observed strong wind ' || printf('%.1f', wind_speed_kmh) || ' kmph at ' || district || ' station' ELSE 'Observed humidity ' || printf('%.1f', humidity_pct) || '% at ' || district || ' station, fog and low visibility likely' END AS finding FROM fx_reports WHERE precipitation_mm >= 2 OR temperature_c >= 38 OR wind_speed_kmh >= 30 OR humidity_pct >= 95")
def observation_findings(r: DataFrame) -> DataFrame:
    return r.select("report_id", c.finding(F.col("district")).alias("finding")).where("finding is not null")


@query("fx_reports", "documents", sql=r"""WITH RECURSIVE x AS MATERIALIZED (SELECT r.report_id, CAST(epoch(r.observed_at) AS BIGINT) t, d.h FROM fx_reports r JOIN (SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://\S+|www\.\S+)', ' ', 'g'), '[#@]([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g')))) AS h FROM documents) d ON d.doc_id = r.text_id WHERE d.h IS NOT NULL),
o AS (SELECT h, report_id, t FROM x QUALIFY row_number() OVER (PARTITION BY h ORDER BY t, report_id) = 1 UNION ALL
SELECT h, report_id, t FROM (SELECT x.h, x.report_id, x.t, row_number() OVER (PARTITION BY x.h ORDER BY x.t, x.report_id) rn FROM o JOIN x ON x.h = o.h AND x.t > o.t + 604800) WHERE rn = 1)
SELECT x.report_id, arg_max(o.report_id, o.t) AS original FROM x JOIN o ON o.h = x.h AND o.t <= x.t GROUP BY x.report_id""")
def hash_duplicates(r: DataFrame, d: DataFrame) -> DataFrame:
    """Texts recur every so many reports, so the window here is a week. A text is hashed once and its digest joined to the reports that carry it."""
    digest = d.select(F.col("doc_id").alias("text_id"), text.content_hash(F.col("text")).alias("text_hash"))
    found = clustering.hash_duplicates(r.select("report_id", "text_id", F.unix_seconds(F.col("observed_at").cast("timestamp")).alias("t")).join(digest, "text_id").drop("text_id"), 168)
    return found.select("report_id", F.coalesce("duplicate_of", "report_id").alias("original"))


@query("fx_reports")
def event_clusters(r: DataFrame) -> DataFrame:
    return clustering.cluster(r)


@query("fx_reports")
def event_rollup(r: DataFrame) -> DataFrame:
    return clustering.event_rollup(clustering.cluster(r), assessed(r))


@query("fx_reports")
def event_history(r: DataFrame) -> DataFrame:
    return clustering.event_history(clustering.cluster(r), assessed(r)).select("event_id", "seq", "report_count", "source_count", "evidence_score", "level", "status")


@query("fx_reports")
def event_top_contributors(r: DataFrame) -> DataFrame:
    return clustering.top_contributors(clustering.cluster(r), assessed(r))


@query("fx_reports", sql="SELECT report_id, raw_event_id, observed_at FROM fx_reports WHERE source_type = 'SOCIAL' AND predicted_event_type = 'RAIN' AND duplicate_of_report_id IS NULL AND observed_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' ORDER BY observed_at DESC, report_id LIMIT 50")
def reports_filtered_page(r: DataFrame) -> DataFrame:
    at = F.col("observed_at").between(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-31").cast("timestamp_ntz"))
    rows = r.where("source_type = 'SOCIAL' and predicted_event_type = 'RAIN' and duplicate_of_report_id is null").where(at)
    return rows.select("report_id", "raw_event_id", "observed_at").orderBy(F.desc("observed_at"), "report_id").limit(50)


@query("fx_reports", sql=f"SELECT source_id, count(*) raw_total, count_if(observed_at >= TIMESTAMP '{fx.REPORTS_AS_OF}' - INTERVAL 1 HOUR AND observed_at <= TIMESTAMP '{fx.REPORTS_AS_OF}') last_hour, count_if(duplicate_of_report_id IS NULL) reports FROM fx_reports GROUP BY 1")
def source_health(r: DataFrame) -> DataFrame:
    as_of = F.lit(fx.REPORTS_AS_OF).cast("timestamp_ntz")
    late = F.col("observed_at").between(as_of - F.expr("INTERVAL 1 HOUR"), as_of)
    return r.groupBy("source_id").agg(F.count("*").alias("raw_total"), F.count_if(late).alias("last_hour"), F.count_if(F.col("duplicate_of_report_id").isNull()).alias("reports"))


@query("fx_reports", "fx_reports", sql="SELECT count(*) lake, count_if(NOT is_noise) serving, count_if(is_noise) only_lake, CAST(0 AS BIGINT) only_serving FROM fx_reports")
def reconcile(lake: DataFrame, serving: DataFrame) -> DataFrame:
    """Ids of the lake against those served (here: all but noise), as one keyed full join."""
    left, right = lake.select("report_id", F.lit(1).alias("l")), serving.where("not is_noise").select("report_id", F.lit(1).alias("r"))
    return left.join(right, "report_id", "full").agg(F.count("l").alias("lake"), F.count("r").alias("serving"), F.count_if(F.col("r").isNull()).alias("only_lake"), F.count_if(F.col("l").isNull()).alias("only_serving"))


@query("fx_reports", "documents", sql="SELECT * FROM (SELECT report_id, concat_ws(',', CASE WHEN length(coalesce(raw_text, '')) < 3 THEN 'TEXT_SHORT' WHEN length(raw_text) > 2000 THEN 'TEXT_LONG' END, CASE WHEN latitude NOT BETWEEN -10 AND 24 THEN 'LATITUDE' END) AS reasons FROM fx_reports) WHERE reasons <> ''")
def intake_validate(r: DataFrame, d: DataFrame) -> DataFrame:
    """The quarantine of intake: rows with the reasons against them. A text is measured once; latitudes end at 24 here, as none lies beyond 90."""
    size = d.select(F.col("doc_id").alias("text_id"), F.length("text").alias("n"))
    return intake.validated(r.select("report_id", "text_id", "latitude", "longitude").join(size, "text_id"), F.col("n"), latitudes=(-10, 24)).where("size(reasons) > 0").select("report_id", F.array_join("reasons", ",").alias("reasons"))


@query("fx_reports", "fx_reports", sql="SELECT report_id FROM fx_reports WHERE report_id % 10 <> 7")
def replay_guard(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Raw events that have no report yet; here those that became duplicates count as done."""
    return raw.join(done.where("duplicate_of_report_id is not null").select("raw_event_id"), "raw_event_id", "left_anti").select("report_id")


@query("fx_reports", "fx_incidents", sql="SELECT 'both' AS part, count(*) n FROM (SELECT predicted_event_type FROM fx_reports INTERSECT SELECT event_type FROM fx_incidents) UNION ALL SELECT 'incidents only', count(*) FROM (SELECT event_type FROM fx_incidents EXCEPT SELECT predicted_event_type FROM fx_reports) UNION ALL SELECT 'any', count(*) FROM (SELECT predicted_event_type FROM fx_reports UNION SELECT event_type FROM fx_incidents)")
def set_ops(r: DataFrame, e: DataFrame) -> DataFrame:
    a, b = r.select(F.col("predicted_event_type").alias("kind")).distinct(), e.select(F.col("event_type").alias("kind")).distinct()
    count = lambda d, name: d.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(b.join(a, "kind", "left_anti"), "incidents only")).unionByName(count(a.unionByName(b).distinct(), "any"))


@query("fx_reports", sql="SELECT x, y, count(*) points, arg_min(kind, (-n, kind)) dominant FROM (SELECT *, count(*) OVER (PARTITION BY x, y, kind) n FROM (SELECT CAST(floor((longitude + 180) / 360 * 64) AS BIGINT) x, CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 64) AS BIGINT) y, predicted_event_type kind FROM fx_reports WHERE latitude IS NOT NULL)) GROUP BY x, y")
def map_tiles(r: DataFrame) -> DataFrame:
    """Points and dominant type of each Web Mercator tile at zoom 6, over all members."""
    lat, size = F.radians("latitude"), 1 << 6
    x = F.floor((F.col("longitude") + 180) / 360 * size)
    y = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * size)
    by = r.where("latitude is not null").groupBy(x.alias("x"), y.alias("y"), F.col("predicted_event_type").alias("kind")).agg(F.count("*").alias("n"))
    return by.groupBy("x", "y").agg(F.sum("n").alias("points"), F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("dominant"))


@query("fx_reports", sql="SELECT r.report_id, s.district_reports, row_number() OVER (PARTITION BY r.district ORDER BY r.observed_at DESC, r.report_id) AS nth FROM fx_reports r JOIN (SELECT district, count(*) district_reports FROM fx_reports GROUP BY 1) s USING (district) QUALIFY nth <= 10")
def district_samples(r: DataFrame) -> DataFrame:
    """The ten newest reports of each district beside its count."""
    w = Window.partitionBy("district").orderBy(F.desc("observed_at"), "report_id")
    # ranked and cut before the join, so a district's rows are never all sent on
    newest = r.select("report_id", "district", "observed_at").withColumn("nth", F.row_number().over(w)).where("nth <= 10")
    return newest.join(r.groupBy("district").agg(F.count("*").alias("district_reports")), "district").select("report_id", "district_reports", "nth")


@query("embeddings", sql="SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR) || '-42'), vec_id) > 0.8 * count(*) OVER (PARTITION BY label) AS is_test FROM embeddings WHERE label IS NOT NULL")
def stratified_split(e: DataFrame) -> DataFrame:
    return models.stratified_split(e.where("label is not null"), "vec_id", "label", 0.2, 42).select("vec_id", "label", "is_test")


@query("embeddings")
def linear_head(e: DataFrame) -> DataFrame:
    """A head fitted on the training part, applied to every row by column expressions."""
    split = models.stratified_split(e.where("label is not null"), "vec_id", "label", 0.2, 42)
    weights = models.fit_head(split.where("not is_test"), "embedding", "label")
    return models.linear_head(e, weights, "embedding").select("vec_id", "label", "predicted", "score")


@query("embeddings")
def classifier_eval(e: DataFrame) -> DataFrame:
    split = models.stratified_split(e.where("label is not null"), "vec_id", "label", 0.2, 42)
    weights = models.fit_head(split.where("not is_test"), "embedding", "label")
    return models.evaluation(models.linear_head(split.where("is_test"), weights, "embedding"), "label", "predicted")
