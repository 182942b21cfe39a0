"""Structured Streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import shared_dir
from tallyspark.sources.tail import register


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file, or the files of the folder, at path as a stream."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString()) if single else source.parquet(path)


def counted_stream(spark: SparkSession, path: str) -> DataFrame:
    """S3: files at path read as a stream to their end and counted by type, batch by batch.

    A batch writes its own folder, so that a batch which is run again replaces what it had written; sums are merged on
    reading. Progress is kept in a checkpoint folder: with the same one, a later run reads new files only.
    """
    lines = file_stream(spark, path)
    out = f"{shared_dir(spark)}/counted-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def tailed(spark: SparkSession, folder: str, out: str, suffix: str = ".jsonl") -> DataFrame:
    """S3: the lines of a folder's session logs as a table at out, that a run brings up to date: it reads what has been added since the last one."""
    lines = register(spark).readStream.format("tail").option("suffix", suffix).load(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    lines.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, offset long, value string, batch int").parquet(f"{out}/rows")


def latest_deliveries(deliveries: DataFrame, minutes: int = 60) -> DataFrame:
    """A stream of deliveries (delivery_id, ts) without those whose id was seen within so many minutes."""
    return deliveries.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(["delivery_id"])
