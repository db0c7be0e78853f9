"""Writers for datasets, bucketed folders, prediction files and audit rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.functions.lists import format_ids


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite a dataset; ``files`` sets the number of files when given."""
    out = df.repartition(files) if files else df
    out.write.mode("overwrite").parquet(path)


def write_parquet_by_key(df: DataFrame, path: str, files: int, key: str, salts: int = 1) -> None:
    """Overwrite a dataset with the rows of a key together in one file.

    ``salts > 1`` spreads each key over at most that many files, for keys that hold very many rows.
    """
    if salts > 1:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        out = df.repartition(files, F.col(key), salt)
    else:
        out = df.repartition(files, key)
    out.write.mode("overwrite").parquet(path)


def write_bucketed_dirs(df: DataFrame, path: str, by: str | Sequence[str], spread: bool = True) -> None:
    """Write every bucket (``sample_id=3/``, ``grid=4x4/``) in one pass.

    Only the buckets present in ``df`` are replaced, so a rerun of one bucket leaves the others. Rows are first brought
    together by bucket in tasks that Spark balances by their measured size: a small bucket is one file, unless it
    shares a shuffle partition with a hot one, which is split into files of about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``. ``spread=False`` leaves out that
    shuffle, for rows that are already together; every task then writes a file for each bucket it holds.
    """
    keys = [by] if isinstance(by, str) else list(by)
    rows = df.hint("rebalance", *keys) if spread else df
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def is_complete(spark: SparkSession, path: str) -> bool:
    """Is there a ``_SUCCESS`` marker? Works on every file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


def write_if_absent(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> bool:
    """Build and write a dataset unless it is already complete; says whether it wrote."""
    if is_complete(spark, path):
        return False
    make().write.mode("overwrite").parquet(path)
    return True


def write_pending_buckets(
    df: DataFrame, bucket: str, n: int, make: Callable[[DataFrame], DataFrame], path: str
) -> list[int]:
    """Run a job for the buckets 0 to n - 1 of a table that are not finished yet, all in one pass.

    ``make`` turns rows of ``df`` into output rows and keeps the column ``bucket``. Finished buckets are listed
    beside the data in ``<path>_finished`` once their rows are written, so a job that was stopped begins again with
    the others; a bucket without rows is finished too. Returns the buckets that this call has run.
    """
    spark, log = df.sparkSession, f"{path}_finished"
    known = spark.read.parquet(log) if is_complete(spark, log) else None
    finished = {r["bucket"] for r in known.distinct().collect()} if known is not None else set()  # at most n numbers
    pending = [b for b in range(n) if b not in finished]
    if pending:
        write_bucketed_dirs(make(df.where(F.col(bucket).isin(pending))), path, bucket)
        spark.createDataFrame([(b,) for b in pending], "bucket int").coalesce(1).write.mode("append").parquet(log)
    return pending


def prediction_text(df: DataFrame, id_col: str = "quadrat_id", ids_col: str = "species_ids") -> DataFrame:
    """Label arrays rendered as ``"[1, 2]"``, ready for a prediction file."""
    return df.select(F.col(id_col), format_ids(F.col(ids_col)).alias(ids_col))


def write_predictions_csv(
    df: DataFrame, path: str, style: str = "quoted", id_col: str = "quadrat_id", single_file: bool = False
) -> None:
    """Prediction file sorted by id: ``quoted`` = all quoted with ``,``; ``plain`` = unquoted with ``;``.

    The sorted ranges are written side by side, in parallel; read in file order they are the sorted
    whole. ``single_file=True`` lets one writer take the sorted ranges in turn, for a result that has
    to be uploaded as one file.
    """
    options = {
        "quoted": {"sep": ",", "quoteAll": True},
        "plain": {"sep": ";", "quote": ""},
    }[style]
    ordered = df.select(id_col, "species_ids").orderBy(id_col)
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").csv(path, header=True, **options)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def audit(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """One row: number of rows, number of columns, schema text and whether the count is as expected."""
    expected = F.lit(expected_rows).cast("bigint")
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(df.schema.simpleString()).alias("schema_text"),
        (F.col("rows") == expected).alias("as_expected"),
    )
