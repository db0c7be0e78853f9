"""Row numbers, ranks and samples per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tileflow.sources.tables import settle

_SHIFT = 2**33  # monotonically_increasing_id() = task number * 2^33 + position in the task


def dense_row_id(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """Number all rows 0, 1, 2, ... in a stated order without gathering them in one task.

    A parallel range sort gives each task one run of rows; the table written from it holds the
    position inside the run, and the sizes of the earlier runs (one number per task) are added.
    """
    placed = settle(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "rows")
    run = F.shiftright("_place", 33)
    runs = placed.groupBy(run.alias("_run")).agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(W.orderBy("_run")) - F.col("_rows")
    starts = runs.select("_run", earlier.alias("_start"))
    return (
        placed.withColumn("_run", run)
        .join(F.broadcast(starts), "_run")  # one row per sort task
        .withColumn(name, F.col("_start") + F.col("_place") % F.lit(_SHIFT))
        .drop("_run", "_start", "_place")
    )


def row_number_by_key(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], name: str = "row_number"
) -> DataFrame:
    """Number the rows of each key from 1, however many rows one key holds."""
    # the rows are settled once, inside: what follows only reads them twice
    numbered = dense_row_id(df, [*key, *order], "_id").withColumn("_group", F.struct(*key))
    first = numbered.groupBy("_group").agg(F.min("_id").alias("_first"))  # a null key is a key like others
    return (
        numbered.join(first, "_group")
        .withColumn(name, F.col("_id") - F.col("_first") + 1)
        .drop("_id", "_first", "_group")
    )


def fixed_batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows in a stated order: adds ``batch`` from 0."""
    rows = dense_row_id(df, order, "_id")
    return rows.withColumn("batch", F.floor(F.col("_id") / size)).drop("_id")


def bounded_chunks(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], size: int = 10_000,
    weight: Column | None = None, most: int = 64 << 20, name: str = "chunk",
) -> DataFrame:
    """Cut each key's rows, in a stated order, into chunks 0, 1, ... of at most ``size`` rows.

    With ``weight`` (the bytes of a row, say) a chunk ends once its rows reach ``most``, so it weighs at most that plus
    its last row. Keys with more than ``size`` rows are numbered by a parallel sort; no task holds a key as a whole. A
    null key is a key like others, and a null weight is 0.
    """
    rows = df.withColumn("_group", F.struct(*key))
    counts = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    crowded = settle(counts.where(F.col("_n") > size).select("_group"), "crowded")
    none = crowded.isEmpty()
    few = rows if none else rows.join(crowded, "_group", "left_anti")
    few = few.withColumn("_block", F.lit(0).cast("bigint"))
    if weight is not None:
        run = W.partitionBy("_group", "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        stretch = F.floor(F.coalesce(F.sum(F.coalesce(weight, F.lit(0))).over(run), F.lit(0)) / most)
        within = F.dense_rank().over(W.partitionBy("_group", "_block").orderBy("_stretch")).cast("bigint") - 1
    else:
        stretch, within = F.lit(0), F.lit(0).cast("bigint")

    def cut(part: DataFrame) -> DataFrame:
        return part.withColumn("_stretch", stretch).withColumn("_within", within).drop("_stretch")

    out = cut(few).withColumn(name, F.col("_within"))
    if not none:
        many = row_number_by_key(rows.join(crowded, "_group", "left_semi").drop("_group"), key, order, "_n")
        block = F.floor((F.col("_n") - 1) / size).cast("bigint")
        many = settle(cut(many.withColumn("_group", F.struct(*key)).withColumn("_block", block)), "blocks")
        blocks = many.groupBy("_group", "_block").agg((F.max("_within") + 1).alias("_chunks"))
        start = F.sum("_chunks").over(W.partitionBy("_group").orderBy("_block")) - F.col("_chunks")
        starts = blocks.select("_group", "_block", start.alias("_start"))  # a row for ``size`` rows
        many = many.join(starts, ["_group", "_block"]).withColumn(name, F.col("_start") + F.col("_within"))
        out = out.select(*df.columns, name).unionByName(many.select(*df.columns, name))
    return out.select(*df.columns, name)


def top_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of each group with their rank.

    The filter on the rank lets Spark keep only k rows per group and task before the shuffle, so a
    group of any size is fine.
    """
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def stratified_sample(
    df: DataFrame, by: str, n: int, seed: int | None = 42, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """At most n random rows per group, or the first n of a stated (hash) order."""
    return top_rows(df, [by], order or [F.rand(seed)], n).drop("rank")
