"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

LATE = "2 hours"  # the longest look-back of the rules


def reports_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Reports from Parquet files as they land; observed_at becomes a timestamp that a watermark takes."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def timeline(reports: DataFrame, minutes: int = 30, late: str = LATE) -> DataFrame:
    """Originals by tumbling window and type; state of a window goes once the watermark passes it. Works on a table, too."""
    rows = reports.where("duplicate_of_report_id is null")
    rows = rows.withWatermark("observed_at", late) if rows.isStreaming else rows
    got = rows.groupBy(F.window("observed_at", f"{minutes} minutes").alias("w"), F.col("predicted_event_type").alias("kind")).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), "kind", "n")


def first_seen(reports: DataFrame, key: str = "raw_event_id", late: str = LATE) -> DataFrame:
    """Each key once within the watermark: state follows the window, not the stream."""
    if reports.isStreaming:
        return reports.withWatermark("observed_at", late).dropDuplicatesWithinWatermark([key])
    return reports.dropDuplicates([key])


def run(reports: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "raw_event_id") -> StreamingQuery:
    """Enrich the distinct keys of each micro-batch and write it to a folder of its own: a batch that runs again adds nothing. first_seen drops keys of earlier batches."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch owns its folder, so a second run of it replaces the first
        enrich(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parsed(lines: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """lines with their JSON as the column `document`, and why as `error`: MALFORMED if it is no document of the schema, NO_ID without a raw_event_id, else null."""
    odd = StructType([*schema.fields, StructField("_odd", StringType())])
    got = lines.withColumn("document", F.from_json(value, odd, {"columnNameOfCorruptRecord": "_odd", "mode": "PERMISSIVE"}))
    error = F.when(F.col("document").isNull() | F.col("document._odd").isNotNull(), "MALFORMED").when(F.col("document.raw_event_id").isNull(), "NO_ID")
    return got.withColumn("error", error).withColumn("document", F.col("document").dropFields("_odd"))


def ingest(lines: DataFrame, schema: StructType, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Good documents of each micro-batch go to path/good, each raw_event_id once ever, poison lines with their reason to path/dead.

    A batch owns its folders, so one that runs again replaces what it wrote; ids that another batch has written are left out by a
    join with the good table, however old they are.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = parsed(batch, schema).persist()
        try:
            rows.where("error is not null").select(*(c for c in ("log", "offset") if c in rows.columns), "value", "error").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
            good = rows.where("error is null").select("document.*").dropDuplicates(["raw_event_id"])
            if number and _exists(spark, f"{path}/good"):
                told = spark.read.parquet(f"{path}/good").where(F.col("batch") != number).select("raw_event_id")
                good = good.join(told, "raw_event_id", "left_anti")
            enrich(good).write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class StageTimes(StreamingQueryListener):
    """Milliseconds of each stage of the latest batches, and rows and failures, as a table that evidence.load_report takes. spark.streams.addListener(StageTimes())"""

    def __init__(self, most: int = 100_000):
        self.rows: deque[tuple[int, str, float, int, bool]] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += [(p.batchId, stage, float(ms), p.numInputRows, True) for stage, ms in p.durationMs.items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.rows.append((-1, "query", 0.0, 0, False))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "batch long, stage string, ms double, rows long, ok boolean")
