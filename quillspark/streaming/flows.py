"""Structured Streaming over landed files: daily sums of closed days, first and latest readings. Each run takes what is there
(availableNow) and ends; its checkpoint is the cursor, so that a later run goes on from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session may do without that
    setting: there the warehouse serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(rows: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """rows by way of a table in the shared folder, for what is read more than once."""
    folder = shared_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def all_changes(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What runs have written in numbered folders below the folder; nothing if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/out/*")


def land(rows: DataFrame, folder: str, part: int) -> None:
    """Adds rows to the landed files of a folder, as its part number so and so."""
    rows.write.mode("overwrite").parquet(f"{folder}/landed/{part:06}")


def landed_parts(spark: SparkSession, folder: str, schema: StructType, files: int | None = None) -> DataFrame:
    """What land() has added and adds later as a stream; so many files a micro-batch, all that are there by default."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/landed/*")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with the schema they have: the path is of a file, or of a folder of files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def run(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Takes what is there into a parquet table of the folder and reads the table."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cursor").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def closed_days(events: DataFrame, late: str, *by: str) -> DataFrame:
    """Sum and number of each day, given out once the watermark has passed its end."""
    seconds = "unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)"  # days are UTC days
    rows = events.withColumn("at", F.timestamp_seconds(F.expr(seconds))).withWatermark("at", late)
    day = F.date_from_unix_date(F.expr("cast(unix_seconds(window.start) div 86400 as int)"))
    return rows.groupBy(F.window("at", "1 day"), *by).agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(day.alias("day"), *by, "value", "n")


def first_of_each(events: DataFrame, late: str, *key: str) -> DataFrame:
    """The first row of each key that comes within the delay; a key that is sent again is dropped, after a restart too."""
    return events.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(list(key)).select(*key)


def latest_table(readings: DataFrame, spark: SparkSession, folder: str, key: list[str], *order: str) -> DataFrame:
    """The latest row of each key of all that the folder's runs have read. Each micro-batch adds its latest rows in a
    numbered folder, so that one that is repeated after a failure writes the same again; nothing is rewritten, and a run
    without new data reads what is there."""
    rest = [c for c in readings.columns if c not in key]

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(readings.columns)

    q = readings.writeStream.foreachBatch(lambda batch, n: last(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    q.option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()
    return last(all_changes(spark, folder, readings.schema))
