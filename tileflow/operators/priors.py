"""Mean vectors, cluster priors and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions.vectors import (
    doubles,
    entries_needed,
    entries_to_vector,
    normalise_sum,
    softmax,
    top_entries,
)
from tileflow.operators.group_sums import plain_keys, sums_by_group


def mean_vector_by_group(df: DataFrame, keys: Sequence[str], vec: str, out: str = "mean_vector") -> DataFrame:
    """Element-wise mean of a group's vectors, added up in every task before the shuffle.

    Null vectors do not count; a group of null vectors only has no mean.
    """
    if plain_keys(df, keys):
        sums = sums_by_group(df, keys, F.col(vec))
        mean = F.when(F.col("n") > 0, F.transform("total", lambda x: x / F.col("n")))
        return sums.select(*keys, mean.alias(out))
    mean = Summarizer.mean(array_to_vector(doubles(F.col(vec))))
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def mean_vector_topk(
    df: DataFrame, vec: str, k: int, on: str = "logits", id_col: str = "image_name"
) -> DataFrame:
    """The k best classes of the mean vector over all rows, given to every image.

    ``on`` says whether logits or their softmax (``"probabilities"``) are averaged.
    """
    values = softmax(F.col(vec)) if on == "probabilities" else F.col(vec)
    mean = mean_vector_by_group(df.select(values.alias("_v")), [], "_v")
    best = mean.select(top_entries(F.col("mean_vector"), k).alias("top"))
    ids = df.select(id_col).distinct().select(id_col, best.scalar().alias("top"))
    return ids.select(id_col, F.posexplode("top").alias("pos", "entry")).select(
        id_col, (F.col("pos") + 1).alias("rank"), "entry.class_idx", "entry.score"
    )


def cluster_prior(df: DataFrame, cluster: str, logits: str, joint: bool = False) -> DataFrame:
    """Class probabilities per cluster: mean softmax of its rows, scaled to sum 1.

    ``joint=True`` takes one softmax over all entries of all rows of a cluster instead of one per row.
    """
    if not joint:
        probs = df.select(cluster, softmax(F.col(logits)).alias("_p"))
        mean = mean_vector_by_group(probs, [cluster], "_p")
        return mean.select(cluster, normalise_sum(F.col("mean_vector")).alias("prior_probabilities"))
    group = F.struct(cluster).alias("_group")  # rows without a cluster are one, as above
    tops = df.groupBy(group).agg(F.max(F.array_max(logits)).cast("double").alias("_top"))
    shifted = df.select(group, logits).join(tops, "_group")
    exps = F.transform(doubles(F.col(logits)), lambda x: F.exp(x - F.col("_top")))
    mean = mean_vector_by_group(shifted.select(f"_group.{cluster}", exps.alias("_p")), [cluster], "_p")
    return mean.select(cluster, normalise_sum(F.col("mean_vector")).alias("prior_probabilities"))


def cumulative_cutoffs(prior: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Classes needed to reach each share of the probability, averaged over clusters."""
    p = F.col("prior_probabilities")
    counts = [
        F.struct(F.lit(float(t)).alias("threshold"), entries_needed(p, float(t)).alias("n"))
        for t in thresholds
    ]
    rows = prior.select(F.inline(F.array(*counts)))
    return rows.groupBy("threshold").agg(F.avg("n").alias("mean_classes"))


def top_species_per_cluster(
    prior: DataFrame, cluster: str, classes: DataFrame, n: int = 5
) -> DataFrame:
    """The n most probable species per cluster, with the columns of the class table."""
    best = prior.select(
        cluster, F.posexplode(top_entries(F.col("prior_probabilities"), n)).alias("pos", "entry")
    ).select(cluster, (F.col("pos") + 1).alias("rank"), "entry.class_idx", F.col("entry.score").alias("probability"))
    return best.join(classes, "class_idx", "left")


def align_to_classes(vectors: DataFrame, classes: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """One vector per class of the class table; a class without rows gets zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return classes.join(vectors, key, "left").withColumn(vec, F.coalesce(doubles(F.col(vec)), zeros))


def merge_tile_topk(tiles: DataFrame, keep: Sequence[str], vec: str, k: int) -> DataFrame:
    """The k best classes of every tile as rows: ``keep..., class_idx, score``."""
    return tiles.select(*keep, F.inline(top_entries(F.col(vec), k)))


def id_prob_rows(df: DataFrame, keep: Sequence[str], vec: str) -> DataFrame:
    """Vector -> one ``class_idx, score`` row per entry."""
    return df.select(*keep, F.posexplode(F.col(vec)).alias("class_idx", "score"))


def id_prob_vector(rows: DataFrame, keys: Sequence[str], out: str = "vector") -> DataFrame:
    """``class_idx, score`` rows -> one vector per key; a key holds one row per class."""
    entries = F.collect_list(F.struct("class_idx", "score"))
    return rows.groupBy(*keys).agg(entries_to_vector(entries).alias(out))
