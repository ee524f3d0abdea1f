"""Near pairs against all pairs, and how much of a report is copied for them."""

import math
import random

from pyspark.sql import functions as F

from hazardspark.operators import dedupe, scoring


def metres(a, b):
    (p, q), (r, s) = [[math.radians(x) for x in y] for y in (a, b)]
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))


def test_near_pairs_are_all_of_them(spark):
    rnd, rows = random.Random(8), []
    for lat, lon in [(10.0, 70.0), (0.01, 179.99), (88.0, -179.9), (-60.5, 180.0), (89.97, 10.0), (-89.99, 100.0)] + [(rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for _ in range(12)]:
        for _ in range(14):
            x, y = min(max(lat + rnd.uniform(-0.12, 0.12), -90.0), 90.0), lon + rnd.uniform(-0.12, 0.12) / max(math.cos(math.radians(lat)), 0.001)
            rows.append((len(rows), x, (y + 180) % 360 - 180, None, rnd.choice([-3600, 0, 3600]) + rnd.randrange(3600)))
    rows += [(len(rows) + i, None, None, rnd.choice(["A", "B", None]), rnd.randrange(7200)) for i in range(30)]
    want = set()
    for a in rows:
        for b in rows:
            if (b[4], b[0]) < (a[4], a[0]) and b[4] >= a[4] - 1800:
                near = b[1] is not None and metres(a[1:3], b[1:3]) <= 10_000 if a[1] is not None else a[3] is not None and a[3] == b[3]
                want |= {(a[0], b[0])} if near else set()
    df = spark.createDataFrame(rows, "report_id long, latitude double, longitude double, district string, s long").withColumn("observed_at", F.timestamp_seconds("s"))
    got = [(r.report_id, r.other_id) for r in dedupe.near_pairs(df.withColumn("normalized_text", F.lit("x"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


def test_few_cells_are_asked(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(rnd.uniform(-70.0, 70.0), rnd.uniform(-180.0, 180.0)) for _ in range(500)], "a double, b double")
    assert rows.agg(F.max(F.size(scoring.wide_cells_around(F.col("a"), F.col("b"), 10_000)))).first()[0] <= 4


def test_texts_beside_the_reports_give_the_same(spark):
    texts = ["heavy rain floods the old market road", "heavy rain floods the old market road!", "strong wind near the bridge", "", None]
    rows = spark.createDataFrame([(i, texts[i % 5], 60 * i) for i in range(40)], "report_id long, normalized_text string, s long")
    rows = rows.select("report_id", "normalized_text", F.lit(10.0).alias("latitude"), F.lit(70.0).alias("longitude"), F.lit(None).cast("string").alias("district"), F.timestamp_seconds("s").alias("observed_at"))
    told = lambda df: sorted((r.report_id, r.other_id, r.similarity) for r in df.collect())
    own = spark.createDataFrame([(x,) for x in [*texts, texts[0]]], "normalized_text string")
    assert told(dedupe.fuzzy(dedupe.without_texts(rows), texts=own)) == told(dedupe.fuzzy(rows)) != []


def test_ordered_stores_no_text_of_a_report(spark, monkeypatch):
    from hazardspark import storage

    seen, at = [], storage.Scratch._at
    monkeypatch.setattr(storage.Scratch, "_at", lambda self, df, path: seen.extend(df.columns) or at(self, df, path))
    texts = ["heavy rain floods the old market road", "heavy rain floods the old market road!"]
    rows = spark.createDataFrame([(i, texts[i]) for i in range(2)], "report_id long, normalized_text string")
    rows = rows.select("report_id", F.lit(1).alias("source_id"), F.lit("").alias("external_id"), F.md5("normalized_text").alias("text_hash"), "normalized_text", F.lit(10.0).alias("latitude"), F.lit(70.0).alias("longitude"), F.lit("D").alias("district"), F.timestamp_seconds(F.col("report_id") * 60).alias("observed_at"))
    got = dedupe.ordered(dedupe.without_texts(rows), texts=rows.select("normalized_text")).collect()
    assert [(r.report_id, r.target, r.method) for r in got] == [(1, 0, "fuzzy_text")] and "digest" in seen and "normalized_text" not in seen
