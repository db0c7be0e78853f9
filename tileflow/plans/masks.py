"""Mask jobs: keep the tile embeddings that lie on vegetation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tileflow.functions.names import n_to_grid
from tileflow.operators.joins import join_multi_key
from tileflow.operators.raster import POSITIVE_MASKS, merge_masks, tile_coverage, tile_coverage_grids
from pyspark.sql import functions as F


def filter_by_mask(
    embeddings: DataFrame, masks: DataFrame, n: int = 4, types: Sequence[str] = POSITIVE_MASKS,
    mask_order: str = "columns",
) -> DataFrame:
    """Tile embeddings with the share of their tile that the merged masks cover (``pct_covered``).

    The masks of an image are columns of one row, so they are merged and measured in place and only the
    n x n shares meet the embeddings. ``mask_order="rows"`` numbers the mask tiles along the rows, as
    older results do.
    """
    merged = merge_masks(masks.select("image_name", *types), types).select("image_name", "mask")
    covered = tile_coverage(merged, n, order=mask_order)
    return join_multi_key(embeddings, covered, ["image_name", "tile"])


def filter_by_mask_grids(
    embeddings: DataFrame, masks: DataFrame, sizes: Sequence[int], types: Sequence[str] = POSITIVE_MASKS
) -> DataFrame:
    """The same for embeddings of several grids (column ``grid``), ready for one partitioned write.

    The masks are read, merged and measured once for all grids.
    """
    merged = merge_masks(masks.select("image_name", *types), types).select("image_name", "mask")
    covered = tile_coverage_grids(merged, sizes).withColumn("grid", n_to_grid(F.col("n"))).drop("n")
    return join_multi_key(embeddings, covered, ["image_name", "grid", "tile"]).select(*embeddings.columns, "pct_covered")
