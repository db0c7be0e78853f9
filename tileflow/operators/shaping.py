"""Filters, projections, sampling and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == value)


def filter_isin(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership in a short literal list (pushed to the scan) or in a table of ids."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi")
    return df.where(F.col(col).isin(list(values)))


def filter_between(df: DataFrame, col: str, low, high) -> DataFrame:
    return df.where(F.col(col).between(low, high))


def filter_min_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """Groups with at least n rows, largest first."""
    return (
        df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= n).orderBy(F.desc("n"), key)
    )


def filter_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix))


def limit_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of a stated order."""
    return df.orderBy(*order).limit(n)


def lot(seed: int, keys: Sequence[str]) -> Column:
    """A number from 0 up to 2 ** 32 drawn for each row from its keys: the same on every run and layout."""
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint")


def sample_fraction(
    df: DataFrame, fraction: float, seed: int, keys: Sequence[str], cap: int | None = None
) -> DataFrame:
    """The rows whose lot lies in the lowest ``fraction``; of them the ``cap`` lowest lots, if given."""
    drawn = df.withColumn("_lot", lot(seed, keys)).where(F.col("_lot") < int(fraction * 2**32))
    return (drawn.orderBy("_lot", *keys).limit(cap) if cap else drawn).drop("_lot")


def random_rows(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """The n rows with the lowest lots."""
    return df.withColumn("_lot", lot(seed, keys)).orderBy("_lot", *keys).limit(n).drop("_lot")


def hash_bucket(col: Column, n: int, algorithm: str = "crc32") -> Column:
    """Stable bucket 0..n-1 of a value's text; ``md5`` is there for engines without crc32."""
    text = col.cast("string")
    if algorithm == "crc32":
        return (F.crc32(text) % n).cast("int")
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def mod_shard(df: DataFrame, col: str, shards: int, shard: int) -> DataFrame:
    return df.where(F.pmod(F.col(col), F.lit(shards)) == shard)


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def dedup_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key in a stated order.

    The ``== 1`` filter lets Spark drop all but one candidate per key and task before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unnest_struct(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, f"{col}.*")


def drop_rename(
    df: DataFrame, drop: Sequence[str] = (), rename: dict[str, str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    out = df.drop(*drop).withColumnsRenamed(rename or {})
    return out.select(*order) if order else out


def sql_stage(statement: str) -> SQLTransformer:
    """An ML pipeline stage that runs ``SELECT ... FROM __THIS__``."""
    return SQLTransformer(statement=statement)


def vector_to_array_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML vectors -> arrays; columns that are arrays already stay."""
    vectors = {
        c: vector_to_array(F.col(c))
        for c in cols
        if not isinstance(df.schema[c].dataType, T.ArrayType)
    }
    return df.withColumns(vectors) if vectors else df


def unpivot_by_name(
    df: DataFrame, ids: Sequence[str], token: str, name_col: str, value_col: str
) -> DataFrame:
    """Wide -> long over every column whose name contains ``token``."""
    wide = [c for c in df.columns if token in c and c not in ids]
    return df.unpivot(list(ids), wide, name_col, value_col)
