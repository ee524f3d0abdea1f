"""Rules that SQL can't state: ordered dedupe against a loop, verdict and alert folds, the whole chain, places, plans without nested loops."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from hazardspark import registry
from hazardspark.operators import analytics, browse, clustering, credibility, dedupe, embedder, evidence, gazetteer, geo, intake, lifecycle, models, scoring

SF = "/root/testdata/sf0.001"


def test_verdicts_fold_in_order(spark):
    events = spark.createDataFrame([(1, "DETECTED"), (2, "DETECTED"), (3, "REJECTED"), (4, "VERIFIED")], "event_id long, status string")
    asked = [(1, "FOO", "a", 1), (1, "VERIFY", "a", 2), (1, "RESOLVE", "a", 3), (1, "VERIFY", "a", 4), (2, "REJECT", "b", 1), (3, "VERIFY", "b", 1), (4, "VERIFY", "b", 1), (9, "VERIFY", "b", 1)]
    now, history, rejects, audit = lifecycle.apply_verdicts(events, spark.createDataFrame(asked, "event_id long, action string, by string, at int"))
    assert dict(now.select("event_id", "status").collect()) == {1: "RESOLVED", 2: "REJECTED", 3: "REJECTED", 4: "VERIFIED"}
    assert sorted((r.event_id, r.old_status, r.new_status) for r in history.collect()) == [(1, "DETECTED", "VERIFIED"), (1, "VERIFIED", "RESOLVED"), (2, "DETECTED", "REJECTED")]
    assert sorted((r.event_id, r["at"], r.why) for r in rejects.collect()) == [(1, 1, "UNKNOWN_ACTION"), (1, 4, "CLOSED"), (3, 1, "CLOSED"), (9, 1, "UNKNOWN_EVENT")]
    assert sorted((r.target_id, r.action) for r in audit.collect()) == [("1", "event.resolved"), ("1", "event.verified"), ("2", "event.rejected"), ("4", "event.verified")]


def test_alert_actions_fold_in_order(spark):
    alerts = spark.createDataFrame([(1, "ACTIVE"), (2, "ACKNOWLEDGED"), (3, "CLOSED")], "alert_id long, status string")
    asked = [(1, "CLOSE", 1), (1, "ACKNOWLEDGE", 2), (1, "CLOSE", 3), (2, "ACKNOWLEDGE", 1), (3, "CLOSE", 1), (2, "SHOUT", 2)]
    now, rejects, audit = lifecycle.apply_alert_actions(alerts, spark.createDataFrame(asked, "alert_id long, action string, at int"))
    assert dict(now.collect()) == {1: "CLOSED", 2: "ACKNOWLEDGED", 3: "CLOSED"}
    assert sorted((r.alert_id, r["at"], r.why) for r in rejects.collect()) == [(1, 2, "CLOSED"), (1, 3, "CLOSED"), (2, 2, "UNKNOWN_ACTION"), (3, 1, "CLOSED")]
    assert [(r.target_id, r.action) for r in audit.collect()] == [("1", "alert.close")]


def test_wording(spark):
    row = spark.createDataFrame([(1250.25, 20.0, 31.0, 50.0, "A"), (None, 40.0, 5.0, 50.0, "B"), (0.0, 20.0, 31.5, 50.0, "C"), (0.0, 1.0, 1.0, 96.0, "D"), (0.0, 1.0, 1.0, 10.0, "E")], "precipitation_mm double, temperature_c double, wind_speed_kmh double, humidity_pct double, city string")
    got = [r[0] for r in row.select(credibility.finding(F.col("city"))).collect()]
    assert got == ["Observed rainfall 1250.25mm/h at A station", "Observed temperature 40.0C at B station, heatwave threshold crossed", "Observed strong wind 31.5 kmph at C station", "Observed humidity 96.0% at D station, fog and low visibility likely", None]
    skies = spark.createDataFrame([(90.0, 0.0, 2.0, 30.0, 0.0), (90.0, 0.0, 2.0, 3.0, 0.0), (90.0, 70.0, 0.0, 3.0, 0.0), (75.0, 0.0, None, None, 0.0), (10.0, 0.0, 0.0, 0.0, 95.0), (10.0, 0.0, 0.0, 0.0, 5.0), (None, 0.0, 9.0, 90.0, 99.0)], "c double, h double, r double, w double, m double")
    kind = credibility.sky(*(F.col(x) for x in "chrwm"))
    rows = skies.select(kind.alias("k"), credibility.sky_text(kind, F.lit("Pune"), F.col("c")).alias("t")).collect()
    assert [r.k for r in rows] == ["CONVECTIVE", "RAIN_BAND", "TOWERING", "OVERCAST", "SURFACE_FOG", None, None]
    assert rows[1].t == "INSAT-3D SECTOR SCAN: dense cloud band over Pune sector, heavy rainfall signature, cloud cover 90.0% #IMD" and rows[5].t is None
    event = spark.createDataFrame([(1, "FLOOD", "X", "Y", 40, 4, 0.625, 0.125, 10)], "event_id long, event_type string, state string, district string, report_count int, source_count int, evidence_score double, corroboration_score double, flagged_report_count int")
    b = lifecycle.bulletins(event, "2024-05-06 07:08:00").first()
    assert b.headline == "Waterlogging and flooding — Y, X" and b.evidence_line == "40 reports from 4 independent sources; reliability 62%, observed-weather agreement 12%."
    assert b.issued_at == "06 May 2024, 07:08 UTC" and b.confidence_note.endswith(" 10 of 40 contributing reports are flagged for credibility review.") and len(b.safety) == 4 and "WHAT TO DO:\n  • Do not attempt" in b.text


def test_support_of_unknown_types_is_neutral(spark):
    row = spark.createDataFrame([(None,), ("METEOR",), ("STRONG_WIND",)], "k string").select("k", *(F.lit(v).alias(n) for n, v in (("precipitation_mm", 0.0), ("temperature_c", 20.0), ("wind_speed_kmh", 60.0), ("humidity_pct", 50.0), ("visibility_m", 1.0))))
    assert [r[0] for r in row.select(scoring.support(F.col("k"))).collect()] == [0.5, 0.5, 1.0]


def test_cells_lose_no_neighbour(spark):
    rnd = random.Random(3)
    base = [(rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for _ in range(150)] + [(0.01, 179.99), (88.0, -179.9), (-60.5, 180.0), (89.95, 10.0)]
    near = []
    for lat, lon in base:
        a = rnd.uniform(0, 2 * math.pi)
        la = max(-90.0, min(90.0, lat + 0.134 * math.sin(a)))
        lo = (lon + 0.134 * math.cos(a) / max(math.cos(math.radians(lat)), 1e-3) + 180) % 360 - 180
        near.append((lat, lon, la, lo))
    df = spark.createDataFrame(near, "a double, b double, c double, d double").where(scoring.metres(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= 15000)
    around, own = scoring.cells_around(F.col("a"), F.col("b"), 15000), scoring.cell(F.col("c"), F.col("d"), 15000)
    assert df.count() > 100 and df.where(~F.array_contains(around, own)).count() == 0


def test_ordered_dedupe_is_a_loop(spark):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(12)]
    rows = []
    for i in range(45):
        body = " ".join(rnd.choices(words, k=8)) if rnd.random() < 0.5 or not rows else rows[rnd.randrange(len(rows))][4]
        if rnd.random() < 0.4:
            body = body[:-2] + "zz"
        v = [x + rnd.gauss(0, 0.05) for x in rnd.choice([(1, 0, 0), (0, 1, 0), (0, 0, 1)])] if rnd.random() < 0.4 else None
        v = v and [x / math.sqrt(sum(y * y for y in v)) for x in v]
        place = (round(10.0 + rnd.choice([0, 0.02, 0.3]), 3), 70.0) if rnd.random() < 0.7 else (None, None)
        rows.append((i, rnd.choice([None, 1, 2]), rnd.choice([None, "x", "y"] + [f"e{i}"] * 9), f"h{body[:12]}", body, *place, rnd.choice([None, "D"]), 60 * rnd.randrange(0, 120), v))
    want, originals = {}, []
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        def metres(o):
            a = math.sin(math.radians(o[5] - r[5]) / 2) ** 2 + math.cos(math.radians(r[5])) * math.cos(math.radians(o[5])) * math.sin(math.radians(o[6] - r[6]) / 2) ** 2
            return 2 * 6371008.8 * math.asin(math.sqrt(a))
        exact = [o for o in originals if None not in (r[1], r[2]) and (o[1], o[2]) == (r[1], r[2])]
        same = [o for o in originals if o[3] == r[3] and o[8] >= r[8] - 7200]
        late = [o for o in originals if o[8] >= r[8] - 1800]
        close = [o for o in late if o[5] is not None and metres(o) <= 10000] if r[5] is not None else [o for o in late if o[7] == r[7]] if r[7] else []
        vectors = [o for o in close if r[9] and o[9]]
        if exact:
            want[r[0]] = ("exact_external_id", None)
        elif same:
            want[r[0]] = ("text_hash", None)
        elif vectors:
            best = max(vectors, key=lambda o: sum(x * y for x, y in zip(o[9], r[9], strict=True)))
            if sum(x * y for x, y in zip(best[9], r[9], strict=True)) >= 0.82:
                want[r[0]] = ("semantic", best[0])
        else:
            alike = [o for o in sorted(close, key=lambda o: (-o[8], o[0])) if difflib.SequenceMatcher(None, r[4], o[4]).ratio() > 0.85]
            if alike:
                want[r[0]] = ("fuzzy_text", alike[0][0])
        if r[0] not in want:
            originals.append(r)
    df = spark.createDataFrame(rows, "report_id long, source_id int, external_id string, text_hash string, normalized_text string, latitude double, longitude double, district string, t long, embedding array<double>")
    df = df.withColumn("observed_at", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    found = {r.report_id: (r.method, r.target) for r in dedupe.ordered(df).collect()}
    assert {k: m for k, (m, _) in found.items()} == {k: m for k, (m, _) in want.items()}
    assert all(found[k][1] == t for k, (_, t) in want.items() if t is not None)
    assert len({m for m, _ in want.values()}) >= 3
    kept = {o[0] for o in originals}
    assert all(t in kept for _, t in found.values())


def test_places(spark):
    cities = spark.createDataFrame([(0, "Mumbai", 19.0, 72.8, "MS", "MH"), (1, "Navi Mumbai", 19.0, 73.0, "Thane", "MH"), (2, "Goa", 15.0, 73.8, "NG", "GA")], "ordinal int, name string, latitude double, longitude double, district string, state string")
    aliases = spark.createDataFrame([(0, "मुंबई", "Mumbai")], "ordinal int, name string, city string")
    gaz = spark.createDataFrame([("than", 22.0, 71.0, "town", "GJ", "SN", True), ("uttarkashi", 30.0, 78.0, "district", "UK", "UT", False), ("uttarakhand", 30.1, 79.0, "state", "UK", None, False), ("market", 1.0, 1.0, "town", "X", "Y", False)], "name string, latitude double, longitude double, kind string, state string, district string, ambiguous boolean")
    said = ["Goat and goa, then Navi Mumbai and Mumbai", "रain in मुंबई", "more than that", "In Than today", "Uttarkashi, Uttarakhand", "the market", None, "Punely"]
    rows = [(i, t, None, None, None) for i, t in enumerate(said)] + [(10, "Goa", 1.5, 2.5, ""), (11, "x", None, 2.5, "Goa"), (12, "x", None, None, "Nowhere")]
    df = spark.createDataFrame(rows, "report_id long, text string, latitude double, longitude double, city_hint string")
    got = {r.report_id: (r.city, r.district, r.location_confidence, r.method) for r in geo.resolve(df, cities, aliases, gaz).collect()}
    none = (None, None, 0.3, "unresolved")
    assert got == {0: ("Navi Mumbai", "Thane", 0.6, "city_match"), 1: ("Mumbai", "MS", 0.6, "city_match"), 2: none, 3: ("Than", "SN", 0.55, "gazetteer_town"), 4: (None, "UT", 0.45, "gazetteer_district"), 5: none, 6: none, 7: none, 10: ("Goa", "NG", 1.0, "gps"), 11: ("Goa", "NG", 0.6, "city_match"), 12: none}


def test_gazetteer_dump(spark, tmp_path):
    (tmp_path / "places.txt").write_text("\t".join(["7", "Köln", "Koln", "", "1.5", "2.5", "P", "PPL", "IN", "", "09", "11", "", "", "9000"]) + "\nshort\trow\n", encoding="utf-8")
    (tmp_path / "admin1.txt").write_text("IN.09\tGujarat\tGujarat\t1\nPK.09\tOther\tOther\t2\n", encoding="utf-8")
    (tmp_path / "admin2.txt").write_text("IN.09.11\tKutch\tKutch\t3\n", encoding="utf-8")
    got = gazetteer.build(*gazetteer.scan_dump(spark, str(tmp_path)), ["koln"]).orderBy("name").collect()
    assert [(r.name, r.state, r.district, r.ambiguous) for r in got] == [("koln", "Gujarat", "Kutch", True), ("köln", "Gujarat", "Kutch", False)]


def test_enrich_twice_adds_nothing(spark):
    payload = "text string, author string, reporter_handle string, observed_at string, latitude double, longitude double, city_hint string, media array<string>"
    rows = [(f"r{i}", 1 + i % 3, "SOCIAL", f"x{i}", (f"Heavy rain and flood in Goa {i % 4} #Rain", "", "bob", "2024-01-01T10:05:00" if i % 2 else "bad", None, None, None, None)) for i in range(12)]
    raw = spark.createDataFrame(rows, f"raw_event_id string, source_id int, source_type string, external_id string, payload struct<{payload.replace(' ', ':').replace(',:', ',')}>").withColumn("collected_at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    cities = spark.createDataFrame([(0, "Goa", 15.0, 73.8, "NG", "GA")], "ordinal int, name string, latitude double, longitude double, district string, state string")
    aliases, gaz = spark.createDataFrame([], "ordinal int, name string, city string"), spark.createDataFrame([], "name string, latitude double, longitude double, kind string, state string, district string, ambiguous boolean")
    obs = spark.createDataFrame([("Goa", 3.0, 20.0, 5.0, 90.0, 100.0)], "city string, precipitation_mm double, temperature_c double, wind_speed_kmh double, humidity_pct double, visibility_m double").withColumn("time", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    got = intake.enrich(raw, cities, aliases, gaz, obs)
    out = {r.raw_event_id: r for r in got.collect()}
    assert len(out) == 12 and all(r.city == "Goa" and r.corroboration.status == "ok" and r.author == "bob" and r.tracked_hashtags == ["rain"] for r in out.values())
    assert sum(r.duplicate_of_report_id is None for r in out.values()) == 1 and {r.duplicate_method for r in out.values()} == {None, "text_hash", "fuzzy_text"} and all(r.corroboration.reliability == r.reliability_score for r in out.values())
    assert intake.enrich(raw, cities, aliases, gaz, obs, got.select("raw_event_id")).count() == 0


def test_enrich_with_vectors(spark):
    """Copies are found by meaning, and what the model takes for no report has no weather signal."""
    payload = "text string, author string, reporter_handle string, observed_at string, latitude double, longitude double, city_hint string, media array<string>"
    said = ["heavy rain and a flood by the river", "the river flood and heavy rain by a", "cricket match tickets rain flood", "", None]
    rows = [(f"r{i}", i, "CITIZEN", f"x{i}", (s, "a", None, f"2024-01-01T10:0{i}:00", 15.0, 73.8, "Goa", None)) for i, s in enumerate(said)]
    raw = spark.createDataFrame(rows, f"raw_event_id string, source_id int, source_type string, external_id string, payload struct<{payload.replace(' ', ':').replace(',:', ',')}>").withColumn("collected_at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    cities = spark.createDataFrame([(0, "Goa", 15.0, 73.8, "NG", "GA")], "ordinal int, name string, latitude double, longitude double, district string, state string")
    aliases, gaz = spark.createDataFrame([], "ordinal int, name string, city string"), spark.createDataFrame([], "name string, latitude double, longitude double, kind string, state string, district string, ambiguous boolean")
    obs = spark.createDataFrame([], "city string, time timestamp_ntz, precipitation_mm double, temperature_c double, wind_speed_kmh double, humidity_pct double, visibility_m double")
    learn = spark.createDataFrame([(s, y) for s, y in [(said[0], 0), ("flood water in the river", 0), ("heavy rain", 0), ("cricket match tickets", 1), ("match tickets", 1), ("cricket", 1)] for _ in range(5)], "text string, y int")
    by = embedder.learned(embedder.fit(learn, size=8))
    head = models.fit_binary(by(learn, "text", "v"), "v", "y", c=1000.0)
    got = {r.raw_event_id: r for r in intake.enrich(raw, cities, aliases, gaz, obs, embedder=by, off_topic=head).collect()}
    assert len(got) == 5 and got["r1"].duplicate_of_report_id == "r0" and got["r1"].duplicate_method == "semantic" and got["r0"].duplicate_of_report_id is None
    assert "NO_WEATHER_SIGNAL" in got["r2"].flags and got["r2"].off_topic_probability >= 0.5 and "NO_WEATHER_SIGNAL" not in got["r0"].flags
    assert got["r3"].embedding is None and "NO_WEATHER_SIGNAL" in got["r3"].flags
    plain = {r.raw_event_id: r for r in intake.enrich(raw, cities, aliases, gaz, obs).collect()}
    assert "NO_WEATHER_SIGNAL" not in plain["r2"].flags and "embedding" not in plain["r2"]


def test_heads_and_embedder(spark):
    rows = [(i, ("rain flood water " if i % 2 else "stock match league ") + f"n{i}", i % 2) for i in range(60)]
    df = models.embedded(spark.createDataFrame(rows, "id long, text string, y int"), "text", 64)
    v = df.first().embedding
    assert len(v) == 64 and math.isclose(sum(x * x for x in v), 1, rel_tol=1e-6)
    head = models.fit_binary(df, "embedding", "y")
    scored = models.binary_head(df, head, "embedding")
    assert models.auc(scored, "y", "probability") > 0.99
    table = {(r.truth, r.predicted): r.n for r in models.confusion(scored.withColumn("hit", (F.col("probability") >= 0.5).cast("int")), "y", "hit").collect()}
    assert table == {(0, 0): 30, (1, 1): 30}
    both = models.compared(scored.withColumn("rule", F.contains("text", F.lit("rain")).cast("int")).withColumn("model", (F.col("probability") >= 0.5).cast("int")), "y", ["rule", "model"])
    assert {r.scorer: r.accuracy for r in both.collect()} == {"rule": 1.0, "model": 1.0}
    assert evidence.hit_rate(df.limit(0), "text").first().rate == 0.0


EAGER = {"dedupe_ordered", "pipeline_enrich", "classifier_eval", "linear_head", "lake_roundtrip", "lake_compaction", "lake_statistics"}  # run jobs before they have a plan


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER))
def test_no_nested_loop(spark, name):
    """Joins of a one-row total are broadcast without a condition; nothing else may compare all pairs."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin BuildRight, Inner, (" not in plan and "BroadcastNestedLoopJoin BuildLeft, Inner, (" not in plan


def test_a_year_of_hourly_copies_in_few_rounds(spark, monkeypatch):
    from hazardspark import storage

    made, at = [], storage.Scratch._at
    monkeypatch.setattr(storage.Scratch, "_at", lambda self, df, path: made.append(path) or at(self, df, path))
    rows = spark.range(8760).select(F.col("id").alias("report_id"), F.lit("h").alias("text_hash"), (F.col("id") * 3600).alias("t"))
    got = clustering.hash_duplicates(rows)
    want, last = {}, None
    for i in range(8760):
        if last is None or i - last > 2:
            last = i
        want[i] = None if last == i else last
    assert {r.report_id: r.duplicate_of for r in got.collect()} == want
    assert len(made) < 20


def _same(spark, rows):
    df = spark.createDataFrame(rows, "report_id long, source_id int, external_id string, text_hash string, normalized_text string, latitude double, longitude double, district string, t long")
    return df.withColumn("observed_at", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")


def test_empty_ids_match_nothing(spark):
    rows = [(i, 1, e, f"h{i}", f"text number {i} " + "abcdefgh"[i] * 40, None, None, None, 86400 * i) for i, e in enumerate(["", "", " ", "x", "x"])]
    assert {r.report_id: r.method for r in dedupe.ordered(_same(spark, rows)).collect()} == {4: "exact_external_id"}


def test_batches_in_order_of_time_are_one_batch(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        body = rnd.choice(["heavy rain floods the old market road", "strong wind near the bridge", f"report {i} of the day " + "".join(rnd.choices("abcdefgh", k=30))])
        rows.append((i, rnd.choice([1, 2]), rnd.choice(["", f"e{i}", f"e{i % 7}"]), f"h{body}", body + rnd.choice(["", "", "!"]), 10.0, 70.0, None, 600 * i))
    df = _same(spark, rows)
    want = {(r.report_id, r.target, r.method) for r in dedupe.ordered(df).collect()}
    got = set()
    for part in range(3):
        now = df.where(F.col("report_id").between(part * 20, part * 20 + 19))
        before = df.where(F.col("report_id") < part * 20)
        copied = spark.createDataFrame([(i,) for i, _, _ in got] or [(-1,)], "report_id long")
        got |= {(r.report_id, r.target, r.method) for r in dedupe.ordered(now, earlier=before.join(copied, "report_id", "left_anti")).collect()}
    assert got == want and len(want) > 10


def test_no_alignment_matches_more_than_the_common_subsequence():
    rnd = random.Random(5)
    for _ in range(60):
        a = "".join(rnd.choices("abc é", k=rnd.randrange(1, 60)))
        b = "".join(x for x in a if rnd.random() < 0.8) + "".join(rnd.choices("abcd", k=rnd.randrange(20)))
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert matched <= dedupe.in_common(a, b) <= min(len(a), len(b))
    assert dedupe.in_common("abcde", "xaxcxe") == 3


def test_several_changes_of_a_key_fold_in_order(spark):
    dim = spark.createDataFrame([(1, "LOW", 5), (2, None, 6)], "k long, level string, n int")
    asked = [(1, "HIGH", None, 2), (1, "MID", None, 1), (1, None, 5, 3), (2, "LOW", 7, 1), (2, "LOW", None, 2), (9, "X", 1, 1)]
    now, audit = lifecycle.apply_changes(dim, spark.createDataFrame(asked, "k long, level string, n int, at int"), "k", ["level", "n"], at="at")
    assert sorted(map(tuple, now.collect())) == [(1, "HIGH", 5), (2, "LOW", 7)]
    assert sorted(map(tuple, audit.collect()), key=str) == sorted([(1, "level", "LOW", "MID"), (1, "level", "MID", "HIGH"), (2, "level", None, "LOW"), (2, "n", "6", "7")], key=str)


def test_box_takes_finite_places_only(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, nan, 2.0), (3, 1.0, inf), (4, None, 1.0), (5, -inf, nan)], "id long, latitude double, longitude double")
    assert [r.id for r in browse.in_box(rows).collect()] == [1] == [r.id for r in browse.in_box(rows, 0, 0, 5, 5).collect()]


def test_times_without_a_zone_are_utc_in_any_session(spark):
    texts = ["2026-09-01T20:00:00", "2026-09-01T20:00:00Z", "2026-09-01 22:00:00+02:00", "2026-09-01", "soon", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        got = rows.select("i", F.unix_seconds(intake.observed_at(F.col("t"), F.timestamp_seconds(F.lit(7)))).alias("s")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.s for r in got] == [1788292800, 1788292800, 1788292800, 1788220800, 7, 7]


def test_exact_quantiles_by_selection(spark):
    import numpy as np

    rnd = random.Random(9)
    cases = [[rnd.gauss(0, 1) for _ in range(400)], [1.0] * 300 + [2.0], [5.0], [float(i % 3) for i in range(200)]]
    for values in cases:
        df = spark.createDataFrame([(x,) for x in [*values, None, float("nan"), float("inf")]], "x double")
        n, got = analytics.exact_quantiles(df, F.col("x"), [0.0, 0.5, 0.9], few=30, buckets=16)
        assert n == len(values) and np.allclose(got, np.quantile(values, [0.0, 0.5, 0.9]), rtol=1e-12, atol=0)
    assert analytics.exact_quantiles(spark.createDataFrame([], "x double"), F.col("x"), [0.5]) == (0, [None])
