"""The shared folder of a session, also for local runs that name none."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tileflow
from tileflow.sources.tables import new_path

# Tasks get the library's helpers with the job, also when the repository is not on their path.
cloudpickle.register_pickle_by_value(tileflow)


def prepare(spark: SparkSession) -> None:
    """A local session that names no shared folder gets one of its own; a cluster has to name one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tileflow-"))


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame into the shared folder and read it back; its lineage ends at the written files.

    ``by`` names columns that have a folder for each value.
    """
    prepare(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
