"""Prior job: clusters of images -> class probabilities for every image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions.names import region_of
from tileflow.operators.counting import dominant_cluster
from tileflow.operators.joins import join_prior
from tileflow.operators.priors import cluster_prior


def region_clusters(images: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``region, dominant_cluster``: the cluster that most images of a region fall into."""
    named = images.select(region_of(F.col("image_name")).alias("region"), cluster)
    return dominant_cluster(named, "region", cluster).select("region", "dominant_cluster")


def image_priors(
    images: DataFrame, clusters: DataFrame, logits: str = "logits", default: int = 0, joint: bool = False
) -> DataFrame:
    """``image_name, dominant_cluster, prior_probabilities`` for every image.

    ``clusters``: ``region, dominant_cluster``; a region without an entry takes the ``default`` cluster.
    """
    regions = images.select("image_name", logits, region_of(F.col("image_name")).alias("region"))
    placed = regions.join(clusters, "region", "left").withColumn(
        "dominant_cluster", F.coalesce("dominant_cluster", F.lit(default))
    )
    prior = cluster_prior(placed, "dominant_cluster", logits, joint)
    return join_prior(placed, prior, "dominant_cluster").select(
        "image_name", "dominant_cluster", "prior_probabilities"
    )
