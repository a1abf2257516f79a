"""Streams of requests and events from files, and their sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stream over one of the given tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a file source wants a folder or a pattern
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/{table}.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(stream: DataFrame, path: str, output_mode: str = "append", on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now, into Parquet below ``path``, and read the result."""
    spark = stream.sparkSession
    run = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{run}/checkpoint")
    if on_batch is not None:
        query = writer.outputMode(output_mode).foreachBatch(on_batch).start()
    elif output_mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{run}/data").start()
    else:  # the last state replaces the one before

        def replace(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").parquet(f"{run}/data")

        query = writer.outputMode(output_mode).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/data") if on_batch is None else spark.range(0)


def hourly_counts(events: DataFrame, late_ms: int = 600_000) -> DataFrame:
    """Events per name, kind and hour of event time; hours close ``late_ms`` after their end."""
    e = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", f"{late_ms} milliseconds")
    return e.groupBy(F.window("at", "1 hour"), "name", "event").agg(F.count("*").alias("n"))
