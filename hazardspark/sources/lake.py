"""The report lake: raw JSON documents, a Parquet silver table, its aggregates and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.operators import analytics

RAW = "id string, source_type string, collected_at string, schema_version int, payload struct<text string, city_hint string, latitude double, longitude double, observed_at string, media array<struct<url string, type string>>, author string, reporter_handle string, is_noise boolean>"
TABLES = {"daily": analytics.intake_daily, "hourly": analytics.intake_hourly, "by_city": analytics.intake_by_city}


def write_raw(docs: DataFrame, path: str) -> None:
    """Append documents under source_type/year/month/day; a row a line, so files stay splittable."""
    at = F.try_to_timestamp("collected_at")
    dated = docs.withColumn("kind", F.col("source_type")).withColumn("year", F.year(at)).withColumn("month", F.month(at)).withColumn("day", F.dayofmonth(at))
    dated.write.mode("append").partitionBy("kind", "year", "month", "day").json(path)


def read_raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents of a lake, by the declared schema; multi_line for one pretty-printed document a file."""
    return spark.read.schema(RAW).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def silver(raw: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """id, source, local time, day, hour, city, noise (false where not said), media. Rows whose time can't be read have a null day."""
    local = F.from_utc_timestamp(F.try_to_timestamp("collected_at"), zone)
    return raw.select(
        "id", "source_type", local.alias("local"), local.cast("date").alias("day"), F.hour(local).alias("hour"), F.col("payload.city_hint").alias("city"),
        F.coalesce("payload.is_noise", F.lit(False)).alias("is_noise"), F.coalesce(F.size("payload.media") > 0, F.lit(False)).alias("has_media"),
    )


def build_silver(spark: SparkSession, raw_path: str, path: str, refresh: bool = False) -> DataFrame:
    """The silver table at path, built if it isn't there or refresh is asked for. Small files are packed into few tasks by the scan."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if refresh or not there:
        rows = silver(read_raw(spark, raw_path))
        # a source may hold a third of the rows: it is written by as many tasks as have its rows
        rows.write.mode("overwrite").partitionBy("source_type").parquet(path)
    return spark.read.parquet(path)


def write_aggregates(table: DataFrame, path: str) -> None:
    """The three intake tables, one file each: they have a row a day and source, an hour, a city."""
    for name, f in TABLES.items():
        f(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def compact(spark: SparkSession, raw_path: str, path: str, file_mb: int = 256) -> None:
    """Many small documents as Parquet files of about file_mb, partitioned by source."""
    raw = read_raw(spark, raw_path)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(raw_path).select("length").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    raw.repartition(max(1, -(-size // (file_mb << 20)))).write.mode("overwrite").partitionBy("source_type").parquet(path)


def statistics(table: DataFrame) -> DataFrame:
    """(objects, partitions, rows) of a file-based table."""
    file = F.col("_metadata.file_path")
    by = table.select(file.alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("objects"), F.count_distinct(F.regexp_extract("f", "^(.*)/[^/]*$", 1)).alias("partitions"), F.sum("n").alias("rows"))


def reconcile(lake: DataFrame, serving: DataFrame, key: str) -> DataFrame:
    """Rows of each side and ids that only one has."""
    both = lake.select(key, F.lit(1).alias("l")).join(serving.select(key, F.lit(1).alias("s")), key, "full")
    return both.agg(F.count("l").alias("lake"), F.count("s").alias("serving"), F.count_if(F.col("s").isNull()).alias("only_lake"), F.count_if(F.col("l").isNull()).alias("only_serving"))


def news(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files: guid (else link, else title), title without the publisher behind it, publisher, published."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, source string, pubDate string").load(path)
    tail = F.concat(F.lit(" - "), F.col("source"))
    title = F.when(F.endswith("title", tail), F.substr("title", F.lit(1), F.length("title") - F.length(tail))).otherwise(F.col("title"))
    when = F.regexp_replace(F.regexp_replace("pubDate", r"^\w+,\s*0?", ""), "(GMT|UTC?|Z)$", "+0000")
    got = rows.select(F.coalesce("guid", "link", "title").alias("guid"), title.alias("title"), "link", F.col("source").alias("publisher"), F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"))
    return got.where("guid is not null").dropDuplicates(["guid"])
