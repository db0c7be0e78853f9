"""From tile scores to predictions: merge tiles, vote, aggregate visits, filter by area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions.lists import first_k_distinct
from tileflow.functions.names import base_plot_id, strip_ext_last
from tileflow.operators.joins import join_back_group, keep_allowed_elements
from tileflow.operators.label_lists import collect_ranked, list_rows, list_union_by_freq, vote_topk
from tileflow.operators.neighbours import distance_table
from tileflow.operators.numbering import top_rows
from tileflow.operators.priors import mean_vector_by_group, merge_tile_topk


def merge_tiles(scores: DataFrame, k: int, image: str = "image_name", tile: str = "tile",
                item: str = "species_id") -> DataFrame:
    """Best k of all tile scores of an image, then distinct in order: one list per image.

    A class that several tiles rank high takes several of the k places, so a list may be shorter.
    """
    best = top_rows(scores, [image], [F.desc("score"), item, tile], k)
    lists = collect_ranked(best, image, item, "rank")
    return lists.withColumn("species_ids", first_k_distinct(F.col("species_ids"), k))


def tile_predictions(tiles: DataFrame, classes: DataFrame, probabilities: str = "probabilities",
                     tile_k: int = 10, k: int = 10, tile: str = "tile") -> DataFrame:
    """Probability vectors per tile -> ``quadrat_id, species_ids``.

    ``classes``: ``class_idx, species_id``, one row per class; a predicted class that is missing there is an error.
    """
    best = merge_tile_topk(tiles, ["image_name", tile], probabilities, tile_k)
    named = classes.select("class_idx", "species_id", F.lit(True).alias("_named"))
    missing = F.raise_error(F.concat(F.lit("no species for class "), F.col("class_idx")))
    scores = best.join(named, "class_idx", "left").withColumn(
        "species_id", F.when(F.col("_named").isNull(), missing).otherwise(F.col("species_id"))
    ).drop("_named")
    lists = merge_tiles(scores, k, tile=tile)
    return lists.select(strip_ext_last(F.col("image_name")).alias("quadrat_id"), "species_ids")


def voted_predictions(scores: DataFrame, n: int = 1, k: int = 10, tile: str = "tile") -> DataFrame:
    """Each tile votes for its n best species; the k species with most votes are predicted."""
    votes = vote_topk(scores, "image_name", tile, "species_id", "score", n, k)
    lists = collect_ranked(votes, "image_name", "species_id", "rank")
    return lists.select(strip_ext_last(F.col("image_name")).alias("quadrat_id"), "species_ids")


def aggregate_visits(preds: DataFrame, k: int | None = None, order: str = "quadrat_id") -> DataFrame:
    """Give every visit of a plot the species of all its visits, most frequent first."""
    named = preds.withColumn("base_quadrat_id", base_plot_id(F.col("quadrat_id")))
    rows = list_rows(named, ["base_quadrat_id", order])
    ranked = list_union_by_freq(rows, "base_quadrat_id", "species_id", [order, "pos"], k)
    lists = collect_ranked(ranked, "base_quadrat_id", "species_id", "rank")
    members = named.select("quadrat_id", "base_quadrat_id")
    return join_back_group(members, lists, ["base_quadrat_id"]).select("quadrat_id", "species_ids")


def filter_by_area(preds: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep only species that occur in an area (a table with one species id column)."""
    return keep_allowed_elements(preds, allowed)


def centroid_classify(
    tiles: DataFrame, vec: str, label: str, tile_k: int = 10, k: int = 10, train: DataFrame | None = None,
    score: str = "cosine_softmax",
) -> DataFrame:
    """Class means of the training vectors score every tile; the tiles of an image are then merged."""
    train = tiles if train is None else train
    means = mean_vector_by_group(train, [label], vec)
    keyed = tiles.select(F.struct("image_name", "tile").alias("_tile"), vec)
    scores = distance_table(keyed, means, "_tile", vec, label, "mean_vector", score, tile_k)
    return merge_tiles(
        scores.select("_tile.image_name", "_tile.tile", F.col(label).alias("species_id"), "score"), k
    )
