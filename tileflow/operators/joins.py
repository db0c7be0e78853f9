"""Equi-joins between images, labels, predictions and small dimension tables.

No hint forces a broadcast: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` (also at run time, from shuffle sizes) and otherwise shuffles
both sides and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.functions.lists import IDS, or_empty
from tileflow.operators.shaping import dedup_by_key


def join_metadata(images: DataFrame, meta: DataFrame, on: str = "image_name",
                  order: Sequence[Column | str] = ()) -> DataFrame:
    """Images with the metadata of their name; duplicates go before the join."""
    unique = dedup_by_key(meta, [on], order or [c for c in meta.columns if c != on])
    return images.join(unique, on, "inner")


def join_top_groups(df: DataFrame, top: DataFrame, on: str = "species_id") -> DataFrame:
    """Rows whose key is in a top-n list."""
    return df.join(top.select(on), on, "left_semi")


def join_labels(df: DataFrame, labels: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Attach label columns; only the key and these columns of the other side are read."""
    return df.join(labels.select(on, *cols), on, "inner")


def join_id_map(neighbours: DataFrame, id_map: DataFrame, cols: Sequence[str] = ("species_id",)) -> DataFrame:
    """Neighbour id -> species of that neighbour."""
    named = id_map.select(F.col("id").alias("nn_id"), *cols)
    return neighbours.join(named, "nn_id", "inner")


def join_multi_key(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "inner")


def join_mask_image(masks: DataFrame, images: DataFrame, on: str = "image_name") -> DataFrame:
    return masks.join(images, on, "inner")


def left_join_fill_empty(ids: DataFrame, preds: DataFrame, on: str, col: str = "species_ids") -> DataFrame:
    """Every id with its list; ids without a prediction get an empty list."""
    joined = ids.select(on).distinct().join(preds.select(on, col), on, "left")
    return joined.withColumn(col, or_empty(F.col(col)))


def outer_join_fill_empty(ids: DataFrame, preds: DataFrame, on: str, col: str = "species_ids") -> DataFrame:
    """Ids and predictions from both sides; a missing list becomes empty."""
    joined = ids.select(on).distinct().join(preds.select(on, col), on, "full_outer")
    return joined.withColumn(col, or_empty(F.col(col)))


def join_back_group(df: DataFrame, group: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach a group's aggregate to each of its members."""
    return df.join(group, list(on), "left")


def join_outer_pairs(
    a: DataFrame, b: DataFrame, on: str, suffixes: tuple[str, str] = ("_a", "_b"), col: str = "species_ids"
) -> DataFrame:
    """Full outer join of two prediction sets: ``on, <col>_a, <col>_b``."""
    left = a.select(on, F.col(col).alias(col + suffixes[0]))
    right = b.select(on, F.col(col).alias(col + suffixes[1]))
    return left.join(right, on, "full_outer")


def join_indicator_diff(
    a: DataFrame, b: DataFrame, on: Sequence[str], only_diff: bool = False
) -> DataFrame:
    """Outer join on all of ``on`` with ``_merge`` = ``left_only``, ``right_only`` or ``both``."""
    left = a.select(*on).withColumn("_l", F.lit(True))
    right = b.select(*on).withColumn("_r", F.lit(True))
    side = (
        F.when(F.col("_r").isNull(), "left_only")
        .when(F.col("_l").isNull(), "right_only")
        .otherwise("both")
    )
    out = left.join(right, list(on), "full_outer").select(*on, side.alias("_merge"))
    return out.where("_merge <> 'both'") if only_diff else out


def join_prior(df: DataFrame, prior: DataFrame, on: str) -> DataFrame:
    """Attach the prior of a row's cluster (or image); rows without one keep a null prior."""
    return df.join(prior.select(on, "prior_probabilities"), on, "left")


def map_lookup_default(
    df: DataFrame, mapping: Mapping | DataFrame, col: str, out: str, default=0
) -> DataFrame:
    """Look a value up in a table of two columns (or a small dict), with a default."""
    if isinstance(mapping, Mapping):
        key_type = df.schema[col].dataType.simpleString()
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), ["_key", "_value"]).select(
            F.col("_key").cast(key_type), "_value"
        )
    key, value = mapping.columns[:2]
    pairs = mapping.select(F.col(key).alias(col), F.col(value).alias(out))
    return df.join(pairs, col, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def keep_allowed_elements(
    preds: DataFrame, allowed: DataFrame, id_col: str = "quadrat_id", col: str = "species_ids"
) -> DataFrame:
    """Drop list elements that are not in the allowed table; order and empty rows stay.

    ``id_col`` names a row, so it is unique. The allowed table may have any size. Gives ``id_col, col``.
    """
    key = allowed.columns[0]
    ids = allowed.select(F.col(key).cast("bigint").alias("_item")).distinct().withColumn("_ok", F.lit(True))
    items = preds.select(id_col, F.posexplode_outer(F.col(col)).alias("_pos", "_item"))
    marked = items.join(ids, "_item", "left")
    entry = F.when(F.col("_ok"), F.struct("_pos", "_item"))  # collect_list leaves out nulls
    ordered = F.array_sort(F.collect_list(entry))
    return marked.groupBy(id_col).agg(F.transform(ordered, lambda e: e["_item"]).cast(IDS).alias(col))


def join_species_metadata(df: DataFrame, meta: DataFrame, on: str = "species") -> DataFrame:
    return df.join(meta, on, "left")


def attach_cluster(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    return df.join(labels, on, "inner")
