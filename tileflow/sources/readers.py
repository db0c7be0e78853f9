"""Readers for image folders, metadata, predictions, country counts, telemetry and id lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileflow.functions import names

TELEMETRY_SCHEMA = """
    nvidia_smi_log struct<
        timestamp: string,
        gpu: struct<
            product_name: string,
            utilization: struct<gpu_util: string, memory_util: string>,
            processes: struct<process_info: string>
        >
    >
"""

PROCESS = "struct<pid: string, process_name: string, type: string, used_memory: string>"


def scan_binary_dir(
    spark: SparkSession, path: str, glob: str = "*.jpg", recursive: bool = True
) -> DataFrame:
    """One row per file: ``path, modificationTime, length, content``."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def image_table(files: DataFrame, base: str | None = None) -> DataFrame:
    """``image_name, path, data`` from scanned files; the path is made relative to ``base``."""
    path = names.relative_path(F.col("path"), base) if base else F.col("path")
    return files.select(
        names.basename(F.col("path")).alias("image_name"),
        path.alias("path"),
        F.col("content").alias("data"),
    )


def scan_image_dir(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded pixels as ``image_name, height, width, channels, data``.

    Bytes are row-major in blue-green-red order, as Spark's image source delivers them. With
    ``drop_invalid=False`` an unreadable file gives height -1 and null data.
    """
    raw = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    unreadable = F.col("image.height") < 0
    return raw.select(
        names.basename(F.col("image.origin")).alias("image_name"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.when(~unreadable, F.col("image.data")).alias("data"),
    )


def scan_metadata_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";"
) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def scan_predictions_csv(
    spark: SparkSession, path: str, sep: str = ",", id_col: str = "quadrat_id"
) -> DataFrame:
    """Prediction file ``<id_col>, species_ids``; the ``;`` form is written without quotes."""
    quote = '"' if sep == "," else ""
    schema = f"{id_col} string, species_ids string"
    return spark.read.schema(schema).csv(path, header=True, sep=sep, quote=quote)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with partition folders (``grid=4x4``) discovered as columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_parquet_recursive(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file below a root; partition folders give no columns."""
    return (
        spark.read.option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def scan_country_json(spark: SparkSession, path: str, shape: str = "counts") -> DataFrame:
    """One JSON object per file.

    ``shape="counts"``: ``{species: {country: n}}`` -> ``species, country, count``;
    ``shape="lists"``: ``{species: [countries]}`` -> ``species, countries``.
    """
    inner = {"counts": "map<string, bigint>", "lists": "array<string>"}[shape]
    text = spark.read.text(path, wholetext=True)
    by_species = text.select(
        F.explode(F.from_json("value", f"map<string, {inner}>")).alias("species", "detail")
    )
    if shape == "lists":
        return by_species.withColumnRenamed("detail", "countries")
    return by_species.select("species", F.explode("detail").alias("country", "count"))


def scan_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """GPU log, one document per line: ``timestamp, product_name, utilization, process_info``."""
    return telemetry_columns(spark.read.schema(TELEMETRY_SCHEMA).json(path))


def telemetry_columns(log: DataFrame) -> DataFrame:
    """Flatten parsed log documents (batch or stream)."""
    return log.select(
        names.log_time(F.col("nvidia_smi_log.timestamp")).alias("timestamp"),
        "nvidia_smi_log.gpu.product_name",
        "nvidia_smi_log.gpu.utilization",
        F.col("nvidia_smi_log.gpu.processes.process_info").alias("process_info"),
    )


def process_rows(telemetry: DataFrame) -> DataFrame:
    """One row per process and poll: ``timestamp, pid, used_memory_mb``.

    The log holds one process as an object and several as an array; both come as JSON text here.
    """
    text = F.trim("process_info")
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return telemetry.select(
        "timestamp", F.explode(F.from_json(listed, f"array<{PROCESS}>")).alias("process")
    ).select(
        "timestamp",
        F.col("process.pid").alias("pid"),
        names.unit_number(F.col("process.used_memory")).alias("used_memory_mb"),
    )


def scan_class_index(spark: SparkSession, path: str) -> DataFrame:
    """Text file whose line number (from 0) is the class index: ``class_idx, species_id``."""
    lines = F.split(F.rtrim("value", F.lit("\n")), "\n")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(lines).alias("class_idx", "line"))
        .select("class_idx", F.trim("line").cast("bigint").alias("species_id"))
    )


def scan_id_list(spark: SparkSession, path: str, name: str = "species_id") -> DataFrame:
    """Text file with one id per line."""
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(F.trim("value").cast("bigint").alias(name))
    )


def from_records(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """A small hand-made table with a stated schema."""
    return spark.createDataFrame(list(rows), schema)
