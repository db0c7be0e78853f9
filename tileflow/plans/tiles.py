"""Tile jobs: cut images, score the tiles, weigh the probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions.vectors import apply_prior, softmax
from tileflow.operators.joins import join_mask_image, join_prior
from tileflow.operators.raster import masked_tiles, tile_image


def tile_embed(images: DataFrame, scorer: Transformer, grid_size: int = 3, order: str = "columns") -> DataFrame:
    """``image_name, tile, cls_embedding`` for every tile of every image.

    ``scorer`` reads the binary column ``data``. The pixels are dropped right behind it.
    """
    scored = scorer.transform(tile_image(images, grid_size, order))
    keep = [c for c in images.columns if c not in ("height", "width", "channels", "data")]
    return scored.select(*keep, "tile", F.col(f"{scorer.getOutputCol()}.cls_token").alias("cls_embedding"))


def masked_tile_embed(
    masks: DataFrame, images: DataFrame, scorer: Transformer, grid_size: int = 3,
    mask_types: Sequence[str] | None = None, order: str = "columns",
) -> DataFrame:
    """``image_name, tile, mask_type, cls_embedding``: every mask type blanks the image on its own.

    Masks stay columns of one row through the join, so each image is shuffled and sent to Python once.
    """
    types = list(mask_types or [c for c in masks.columns if "mask" in c])
    pictures = images.select("image_name", "height", "width", "channels", "data")
    joined = join_mask_image(masks.select("image_name", *types), pictures)
    scored = scorer.transform(masked_tiles(joined, types, grid_size, order))
    return scored.select(
        "image_name", "tile", "mask_type", F.col(f"{scorer.getOutputCol()}.cls_token").alias("cls_embedding")
    )


def tile_classify(
    images: DataFrame, scorer: Transformer, grid_size: int = 3, prior: DataFrame | None = None,
    order: str = "columns", renormalise: bool = False,
) -> DataFrame:
    """``image_name, tile, probabilities``: softmax of the logits, times the prior of the image if given.

    ``prior``: ``image_name, prior_probabilities``.
    """
    tiles = tile_image(images, grid_size, order) if grid_size > 1 else images.withColumn("tile", F.lit(0))
    logits = F.col(f"{scorer.getOutputCol()}.logits").alias("logits")
    scored = scorer.transform(tiles).select("image_name", "tile", logits)
    probabilities = softmax(F.col("logits"))
    if prior is not None:
        scored = join_prior(scored, prior, "image_name")
        probabilities = apply_prior(probabilities, F.col("prior_probabilities"), renormalise)
    return scored.select("image_name", "tile", probabilities.alias("probabilities"))
