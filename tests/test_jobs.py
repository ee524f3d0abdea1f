"""Folds against a plain loop over all rows, lake round trip, streams against batches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazardspark import fixtures
from hazardspark.operators import clustering, lifecycle, models
from hazardspark.sources import lake
from hazardspark.streaming import jobs

SF = "/root/testdata/sf0.001"


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(h, 1)))


def walked(rows, radius_m=15000, seconds=5400):
    """Event of each report by one walk over all rows."""
    events, want = [], {}
    for r in sorted(rows, key=lambda r: (r.observed_at, r.report_id)):
        near = [(metres((e["lat"], e["lon"]), (r.latitude, r.longitude)), e["id"], e) for e in events if e["kind"] == r.predicted_event_type and (r.observed_at - e["last"]).total_seconds() <= seconds]
        near = [x for x in near if x[0] <= radius_m]
        if near:
            e = min(near, key=lambda x: x[:2])[2]
            e["lat"], e["lon"] = round((e["lat"] * e["n"] + r.latitude) / (e["n"] + 1), 6), round((e["lon"] * e["n"] + r.longitude) / (e["n"] + 1), 6)
            e["n"], e["last"] = e["n"] + 1, max(e["last"], r.observed_at)
        else:
            e = {"id": r.report_id, "kind": r.predicted_event_type, "lat": r.latitude, "lon": r.longitude, "n": 1, "last": r.observed_at}
            events.append(e)
        want[r.report_id] = e["id"]
    return want


def test_clusters(spark):
    reports = fixtures.view(spark, SF, "fx_reports")
    want = walked(reports.where("latitude is not null and duplicate_of_report_id is null").select("report_id", "predicted_event_type", "latitude", "longitude", "observed_at").collect())
    got = {r.report_id: r.event_id for r in clustering.cluster(reports).collect()}
    assert got == want and len(set(want.values())) < len(want)


def _busy(spark, n, spread, step, seed=4):
    """Reports of two types in an area without a pause; every 40 of them share a second."""
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["FLOOD", "FOG"]), 10 + rnd.random() * spread, 70 + rnd.random() * spread, None, 1_700_000_000 + (i if i % 400 >= 40 else i - i % 400) * step) for i in range(n)]
    rows += [(n, "FLOOD", float("nan"), 70.0, None, 1_700_000_000), (n + 1, "FLOOD", 10.0, None, None, 1_700_000_000), (n + 2, "FLOOD", 10.0, 70.0, 1, 1_700_000_000)]
    schema = "report_id long, predicted_event_type string, latitude double, longitude double, duplicate_of_report_id long, observed_at long"
    return spark.createDataFrame(rows, schema).withColumn("observed_at", F.timestamp_seconds("observed_at"))


@pytest.mark.parametrize("spread, step, most", [(1.5, 40, 60), (0.3, 300, 40)])
def test_clusters_cut_in_time(spark, spread, step, most):
    """Long sessions in slabs: events that turn over, and some that live through many slabs, so that starts are handed on one by one."""
    reports = _busy(spark, 450, spread, step)
    want = walked(reports.where("report_id < 450").collect())
    got = clustering.cluster(reports, most=most).collect()
    assert {r.report_id: r.event_id for r in got} == want and len(got) == len(want) == 450
    assert {tuple(r) for r in got} == {tuple(r) for r in clustering.cluster(reports).collect()}


def test_slabs_are_small(spark):
    rows, slabs = clustering.safe_groups(_busy(spark, 900, 0.3, 30).where("report_id < 900").selectExpr("report_id", "predicted_event_type kind", "latitude", "longitude", "unix_seconds(observed_at) t"), most=60)
    sizes = rows.groupBy("kind", "area", "session", "slab").count().collect()
    assert max(r["count"] for r in sizes) <= 60 + 40 and len(sizes) == slabs.count() > 8
    assert rows.count() == 900 and {r.slab for r in sizes} == set(range(max(r.slab for r in sizes) + 1))


def test_clusters_anywhere(spark):
    """A wide radius, high latitudes, and both sides of the 180th meridian."""
    place = [(70.0, 10.0), (70.0, 10.9), (-17.0, 179.97), (-17.0, -179.97), (-17.0, 179.99), (89.99, 0.0), (89.99, 180.0)]
    rows = [(i, "FOG", y, x, None, 1_700_000_000 + i) for i, (y, x) in enumerate(place)]
    schema = "report_id long, predicted_event_type string, latitude double, longitude double, duplicate_of_report_id long, observed_at long"
    reports = spark.createDataFrame(rows, schema).withColumn("observed_at", F.timestamp_seconds("observed_at"))
    assert {r.report_id: r.event_id for r in clustering.cluster(reports).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5}
    assert {r.report_id: r.event_id for r in clustering.cluster(reports, radius_m=40_000).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5}
    far = [(i, "FOG", 10.0, 70 + x, None, 1_700_000_000 + i) for i, x in enumerate([0.0, 1.7, 0.9])]
    reports = spark.createDataFrame(far, schema).withColumn("observed_at", F.timestamp_seconds("observed_at"))
    assert {r.report_id: r.event_id for r in clustering.cluster(reports, radius_m=100_000).collect()} == walked(reports.collect(), 100_000)


def test_no_clusters(spark):
    assert clustering.cluster(_busy(spark, 3, 1.0, 1).where("false")).collect() == []


def test_hash_duplicates(spark):
    rows = [(i, "ab"[i % 7 == 0], i * 1500 + (i % 5) * 3000) for i in range(60)] + [(100, "c", 5), (101, None, 5)]
    want, originals = {}, []
    for i, h, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if h is not None:
            seen = [o for o in originals if o[1] == h and t - o[2] <= 7200]
            want[i] = seen[-1][0] if seen else None
            originals += [] if seen else [(i, h, t)]
    got = clustering.hash_duplicates(spark.createDataFrame(rows, "report_id long, text_hash string, t long"))
    assert {r.report_id: r.duplicate_of for r in got.collect()} == want


def test_alert_transitions(spark):
    levels = ["YELLOW", "ORANGE", "ORANGE", "RED", "ORANGE", "RED", "GREEN", "GREEN", "RED", "YELLOW"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "event_id int, seq int, level string")
    got = [(r.seq, r.change, r.previous, r.alert_no) for r in lifecycle.alert_transitions(rows).orderBy("seq").collect()]
    assert got == [(1, "RAISE", None, 1), (3, "ESCALATE", "ORANGE", 1), (6, "CLOSE", None, 1), (8, "RAISE", None, 2), (9, "CLOSE", None, 2)]


def test_head(spark):
    rows = [(i, [1.0 if i % 2 else -1.0, 0.5], i % 2) for i in range(40)] + [(99, [1.0], 1), (100, None, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    got = {r.id: r.predicted for r in models.linear_head(df, models.fit_head(df.where("id < 40"), "v", "y"), "v").collect()}
    assert all(got[i] == str(i % 2) for i in range(40)) and got[99] is None and got[100] is None


def test_lake(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    payload = "named_struct('text', 'x', 'city_hint', 'Pune', 'is_noise', IF(id % 2 = 0, true, null))"
    docs = spark.range(10).selectExpr("cast(id as string) id", "IF(id < 6, 'citizen', 'news') source_type", "concat('2026-09-0', id % 3 + 1, 'T20:00:00Z') collected_at", "1 schema_version", f"{payload} payload")
    lake.write_raw(docs, raw)
    table = lake.build_silver(spark, raw, f"{tmp_path}/silver")
    assert table.count() == 10 and table.where("is_noise").count() == 5
    assert {str(r.day) for r in table.select("day").distinct().collect()} == {"2026-09-02", "2026-09-03", "2026-09-04"}
    lake.write_aggregates(table, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/daily").agg(F.sum("documents")).first()[0] == 10
    lake.compact(spark, raw, f"{tmp_path}/packed")
    s = lake.statistics(spark.read.parquet(f"{tmp_path}/packed")).first()
    assert (s.rows, s.partitions) == (10, 2)
    assert tuple(lake.reconcile(table, docs.where("id > 2"), "id").first()) == (10, 7, 3, 0)


def test_news(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>Rain in Pune - Daily</title><link>l</link><source>Daily</source><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>Other</title><guid>g</guid></item></channel></rss>")
    got = {r.guid: r for r in lake.news(spark, str(tmp_path)).collect()}
    assert got["l"].title == "Rain in Pune" and str(got["l"].published) == "2026-01-05 10:00:00" and got["g"].title == "Other"


def test_stream_is_batch(spark, tmp_path):
    reports = fixtures.view(spark, SF, "fx_reports").drop("raw_text")
    reports.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = jobs.reports_stream(spark, f"{tmp_path}/in", schema)
    q = jobs.timeline(stream).writeStream.format("memory").queryName("timeline_of_stream").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = jobs.timeline(reports.withColumn("observed_at", F.col("observed_at").cast("timestamp")))
    assert sorted(map(tuple, spark.table("timeline_of_stream").collect())) == sorted(map(tuple, want.collect()))
    q = jobs.run(jobs.first_seen(stream), lambda d: d.select("raw_event_id", "predicted_event_type"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(90)
    assert spark.read.parquet(f"{tmp_path}/out").count() == reports.count()
