"""Incremental forms of two batch loops: files that arrive in a folder, and a growing GPU log.

They extend the batch jobs; the batch results do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tileflow.operators.shaping import hash_bucket
from tileflow.sources.readers import TELEMETRY_SCHEMA, image_table, process_rows, telemetry_columns

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """New files of a folder as ``image_name, path, data``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return image_table(files)


def ingest_files(images: DataFrame, out: str, checkpoint: str, buckets: int = 20) -> StreamingQuery:
    """Append what is new to a dataset in ``sample_id=k/`` folders, then stop; a rerun takes only later files."""
    bucketed = images.withColumn("sample_id", hash_bucket(F.col("image_name"), buckets))
    return (
        bucketed.writeStream.format("parquet")
        .partitionBy("sample_id")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )


def stream_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return telemetry_columns(spark.readStream.schema(TELEMETRY_SCHEMA).json(path))


def windowed_usage(telemetry: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Polls and memory per process and window; records later than ``late`` are dropped."""
    rows = process_rows(telemetry).withColumn("ts", F.timestamp_seconds("timestamp"))
    return (
        rows.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "pid")
        .agg(
            F.count("*").alias("interval_count"),
            F.min("used_memory_mb").alias("min_used_memory_mb"),
            F.max("used_memory_mb").alias("max_used_memory_mb"),
            F.avg("used_memory_mb").alias("avg_used_memory_mb"),
        )
        .select("window.start", "window.end", "pid", "interval_count", "min_used_memory_mb", "max_used_memory_mb",
                "avg_used_memory_mb")
    )


def write_windows(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a dataset, then stop."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
