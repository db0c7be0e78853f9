"""Reports over a GPU log (see ``scan_telemetry``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions.names import unit_number


def newest_first(telemetry: DataFrame) -> DataFrame:
    return telemetry.orderBy(F.desc("timestamp"))


def process_usage(processes: DataFrame) -> DataFrame:
    """Per process: first and last poll, number of polls, memory statistics and duration in seconds."""
    memory = "used_memory_mb"
    return (
        processes.groupBy("pid")
        .agg(
            F.min("timestamp").alias("start"),
            F.max("timestamp").alias("end"),
            F.count("timestamp").alias("interval_count"),
            F.min(memory).alias("min_used_memory_mb"),
            F.max(memory).alias("max_used_memory_mb"),
            F.avg(memory).alias("avg_used_memory_mb"),
            F.stddev(memory).alias("stddev_used_memory_mb"),
        )
        .withColumn("duration_sec", F.col("end") - F.col("start"))
        .orderBy("pid")
    )


def utilisation_series(telemetry: DataFrame) -> DataFrame:
    """Utilisation in percent over the minutes since the first sample."""
    start = telemetry.agg(F.min("timestamp").alias("start"))
    return telemetry.select(
        ((F.col("timestamp") - start.scalar()) / 60).alias("elapsed_minutes"),
        "timestamp",
        unit_number(F.col("utilization.gpu_util")).alias("gpu_util"),
        unit_number(F.col("utilization.memory_util")).alias("memory_util"),
    )
