"""Ingest of an image folder: scan, names, metadata, one dataset clustered by a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileflow.operators.joins import join_metadata
from tileflow.sources.readers import image_table, scan_binary_dir, scan_metadata_csv


def images_with_metadata(
    images: DataFrame, meta: DataFrame, on: str = "image_name", order: Sequence[Column | str] = ()
) -> DataFrame:
    """Images that have metadata, with the first row of their name in ``order`` (by default all other columns).

    A column of the metadata that the images have as well becomes ``meta_<name>``. Images whose name is null or
    unknown are left out; ``ingest_report`` counts them.
    """
    clash = {c: f"meta_{c}" for c in meta.columns if c != on and c in images.columns}
    return join_metadata(images, meta.withColumnsRenamed(clash), on, order)


def ingest_report(files: DataFrame, meta: DataFrame, on: str = "image_name") -> DataFrame:
    """One row: ``files, names, with_metadata, without_metadata, metadata_rows, repeated_rows, without_file``.

    ``names`` are distinct; ``with_metadata`` and ``without_metadata`` count files, ``without_file`` names. Only names
    are read, so the scan does not open any file.
    """
    here = files.groupBy(on).agg(F.count("*").alias("files"))
    there = meta.groupBy(on).agg(F.count("*").alias("rows"))
    both = here.join(there, on, "full")
    n_files, n_rows = F.coalesce("files", F.lit(0)), F.coalesce("rows", F.lit(0))

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    return both.agg(
        total(n_files, "files"),
        F.count(F.when(n_files > 0, F.col(on))).alias("names"),
        total(F.when(n_rows > 0, n_files), "with_metadata"),
        total(F.when(n_rows == 0, n_files), "without_metadata"),
        total(n_rows, "metadata_rows"),
        total(F.greatest(n_rows - 1, F.lit(0)), "repeated_rows"),
        F.count(F.when(n_files == 0, F.col(on))).alias("without_file"),
    )


def ingest_folder(
    spark: SparkSession, path: str, metadata: str, schema: str | T.StructType, out: str, glob: str = "*.jpg",
    base: str | None = None, sep: str = ";", key: str = "species_id", order: Sequence[Column | str] = (),
) -> DataFrame:
    """Scan a folder and a metadata file, join them, and write the dataset ``out``; gives what was written.

    ``image_name``, ``path`` (without ``file:<base>`` if ``base`` is given), ``data`` and the metadata. Rows of a
    ``key`` lie together: tasks are balanced by their measured size, so a hot key is several files and rare ones
    share a file. The bytes of the images are shuffled once for that, and once more only where the metadata are
    too large to be sent to every task.
    """
    images = image_table(scan_binary_dir(spark, path, glob), base)
    joined = images_with_metadata(images, scan_metadata_csv(spark, metadata, schema, sep), order=order)
    joined.hint("rebalance", key).write.mode("overwrite").parquet(out)
    return spark.read.schema(joined.schema).parquet(out)
