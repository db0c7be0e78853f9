"""Retrieval job: neighbours of every tile -> species per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions.names import strip_ext_first
from tileflow.operators.joins import join_id_map, left_join_fill_empty
from tileflow.operators.label_lists import collect_ranked
from tileflow.operators.neighbours import slice_neighbours, zip_explode_neighbours
from tileflow.operators.thresholds import (
    global_threshold_topn,
    min_of_medians,
    percentile_threshold_by_image,
)
from tileflow.sources.tables import settle
from tileflow.sources.writers import prediction_text


def id_map(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``id, image_name, species_id`` of the index rows."""
    return df.select(F.col(id_col).alias("id"), "image_name", "species_id")


def species_distances(neighbours: DataFrame, ids: DataFrame) -> DataFrame:
    """Least median distance per image and species.

    ``neighbours``: ``image_name, tile, grid, nn_id, distance``.
    """
    named = join_id_map(neighbours.select("image_name", "tile", "grid", "nn_id", "distance"), ids)
    return min_of_medians(
        named, ["image_name", "tile", "grid", "species_id"], ["image_name", "species_id"], "distance"
    )


def knn_classify(
    knn: DataFrame, ids: DataFrame, grids: Sequence[int], k: int = 10, p: float = 0.1,
    mode: str = "per_image", cap: int | None = 10,
) -> DataFrame:
    """``plot_id, species_ids`` from neighbour arrays (``image_name, tile, grid, nn_ids, distances``).

    ``mode``: threshold ``per_image`` or ``global``; only the latter is capped per image. The species of
    an image come nearest first. Images without a species keep an empty list.
    """
    chosen = slice_neighbours(knn.where(F.col("grid").isin([f"{g}x{g}" for g in grids])), k)
    rows = zip_explode_neighbours(chosen, ["image_name", "tile", "grid"])
    distances = species_distances(rows, ids)
    if mode == "global":
        kept = global_threshold_topn(settle(distances, "distances"), "min_med_distance", p, cap)
    elif mode == "per_image":
        kept = percentile_threshold_by_image(settle(distances, "distances"), "min_med_distance", p)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    lists = collect_ranked(
        kept.withColumn("_key", F.struct("min_med_distance", "species_id")), "image_name", "species_id", "_key"
    )
    every = left_join_fill_empty(chosen, lists, "image_name")
    plots = every.withColumn("plot_id", strip_ext_first(F.col("image_name")))
    return prediction_text(plots, "plot_id")

