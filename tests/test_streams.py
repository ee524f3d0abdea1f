"""Streams against tables: clusters over a restart, the log source, poison rows, replays and stage times."""

import json
import random
import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardspark.operators import clustering, evidence
from hazardspark.streaming import clusters, jobs, source

REPORTS = "report_id long, predicted_event_type string, latitude double, longitude double, duplicate_of_report_id long, observed_at timestamp"


def _reports(spark, n=120):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        at = 1_700_000_000 + 900 * i + rnd.randrange(900)
        rows.append((i, rnd.choice(["FLOOD", "FOG", None]), 10 + rnd.random() * 0.4 if i % 9 else None, 70 + rnd.random() * 0.4, 1 if i % 13 == 0 else None, at))
    return spark.createDataFrame(rows, REPORTS.replace("timestamp", "long")).withColumn("observed_at", F.timestamp_seconds("observed_at"))


def test_clusters_of_a_stream_over_a_restart(spark, tmp_path):
    reports = _reports(spark)
    want = {tuple(r) for r in clustering.cluster(reports).collect()}
    end = reports.orderBy(F.desc("report_id")).limit(1).withColumn("observed_at", F.timestamp_seconds(F.lit(1_900_000_000))).withColumn("report_id", F.lit(-1).cast("long")).withColumn("duplicate_of_report_id", F.lit(None).cast("long")).withColumn("latitude", F.lit(0.0)).withColumn("predicted_event_type", F.lit("END"))
    parts = [reports.where(F.col("report_id").between(a, a + 39)) for a in (0, 40, 80)] + [end]
    for i, part in enumerate(parts):  # a new query each time, from the checkpoint of the one before
        part.coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        rows = spark.readStream.schema(REPORTS).parquet(f"{tmp_path}/in")
        q = clusters.clusters(rows).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("report_id", "event_id", "seq", "distance_m")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def _document(i):
    return json.dumps({"raw_event_id": f"raw-{i}", "n": i})


def test_log_source_poison_and_replay(spark, tmp_path):
    logs, schema = tmp_path / "logs", StructType.fromDDL("raw_event_id string, n long")
    logs.mkdir()
    times = jobs.StageTimes()
    spark.streams.addListener(times)
    run = lambda: jobs.ingest(source.stream(spark, str(logs), committed=str(tmp_path / "committed"), maxBytesPerPart="50"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    (logs / "a.jsonl").write_text("".join(_document(i) + "\n" for i in range(10)) + "not json\n" + '{"n": 3}\n' + '{"raw_event_id": "half"')
    assert run()
    (logs / "a.jsonl").open("a").write(', "n": 7}\n' + _document(3) + "\n")  # the half line ends, an old id comes again
    (logs / "b.jsonl").write_text(_document(20) + "\n" + '{"raw_event_id": "x", "n": "word"}\n' + _document(20) + "\n")
    assert source.lag(str(logs), str(tmp_path / "committed"))["b.jsonl"] > 0
    assert run()
    assert run()  # nothing new
    good = spark.read.parquet(str(tmp_path / "out/good")).select("raw_event_id", "n").collect()
    assert sorted(map(tuple, good)) == sorted([(f"raw-{i}", i) for i in [*range(10), 20]] + [("half", 7)])
    dead = spark.read.parquet(str(tmp_path / "out/dead")).select("log", "value", "error").collect()
    assert sorted(map(tuple, dead)) == sorted([("a.jsonl", "not json", "MALFORMED"), ("a.jsonl", '{"n": 3}', "NO_ID"), ("b.jsonl", '{"raw_event_id": "x", "n": "word"}', "MALFORMED")])
    for _ in range(40):
        if any(r[1] == "addBatch" for r in times.rows):
            break
        time.sleep(0.25)
    spark.streams.removeListener(times)
    told = {r.stage: r for r in evidence.load_report(times.table(spark)).collect()}
    assert told["addBatch"].runs >= 2 and told["addBatch"].errors == 0 and 0 < told["addBatch"].share < 1


def test_parts_of_a_log_hold_each_line_once(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"".join(b"x" * (i % 7) + b"\n" for i in range(100)) + b"open")
    for most in (1, 3, 10, 10_000):
        reader = source.LogReader({"path": str(tmp_path), "maxbytesperpart": str(most)})
        lines = [v for p in reader.partitions({}, reader.latestOffset()) for _, _, v in reader.read(p)]
        assert lines == ["x" * (i % 7) for i in range(100)]
