"""Scaling, projection and clustering of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tileflow.functions.vectors import doubles
from tileflow.operators.numbering import top_rows
from tileflow.operators.priors import mean_vector_by_group
from tileflow.sources.tables import settle


def standardise(df: DataFrame, vec: str, out: str = "scaled") -> DataFrame:
    """Zero mean and unit (population) deviation per entry; a constant entry becomes 0."""
    v = array_to_vector(doubles(F.col(vec)))
    stats = df.agg(
        F.struct(
            vector_to_array(Summarizer.mean(v)).alias("mean"),
            vector_to_array(Summarizer.std(v)).alias("std"),
            F.count(vec).cast("double").alias("n"),
        ).alias("stats")
    ).select(
        F.arrays_zip(
            F.col("stats.mean"),
            F.transform("stats.std", lambda s: s * F.sqrt((F.col("stats.n") - 1) / F.col("stats.n"))).alias("std"),
        ).alias("stats")
    )
    scale = F.zip_with(
        doubles(F.col(vec)), F.col("_stats"),
        lambda x, s: F.when(s["std"] > 0, (x - s["mean"]) / s["std"]).otherwise(0.0),
    )
    return df.withColumn("_stats", stats.scalar()).withColumn(out, scale).drop("_stats")


def with_vector(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(doubles(F.col(vec))))


def pca_project(df: DataFrame, vec: str, k: int = 2, out: str = "projection") -> DataFrame:
    """Projection on the k main axes (axes are found up to their sign)."""
    data = with_vector(df, vec)
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(data)
    return model.transform(data).withColumn(out, vector_to_array("_pca")).drop("features", "_pca")


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    data = with_vector(df, vec)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=out).fit(data)
    return model.transform(data).drop("features")


def cluster_pipeline(k: int, seed: int = 42, dims: int = 2) -> Pipeline:
    """Scaler -> projection -> k-means over an ML vector column ``features``; gives ``cluster``.

    The fitted model can be written, read and used on new rows.
    """
    return Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            PCA(k=dims, inputCol="scaled", outputCol="projection"),
            KMeans(k=k, seed=seed, featuresCol="projection", predictionCol="cluster"),
        ]
    )


def fit_clusters(df: DataFrame, vec: str, k: int, seed: int = 42, dims: int = 2) -> PipelineModel:
    return cluster_pipeline(k, seed, dims).fit(with_vector(df, vec))


def predict_clusters(model: PipelineModel, df: DataFrame, vec: str) -> DataFrame:
    rows = model.transform(with_vector(df, vec))
    return rows.withColumn("projection", vector_to_array("projection")).drop("features", "scaled")


def _assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centre of its own species for every row; ties go to the lower centre."""
    groups = centres.groupBy("species").agg(
        F.array_sort(F.collect_list(F.struct("centroid", "centre"))).alias("centres")
    )
    def gap(centre: Column) -> Column:
        squares = F.zip_with(centre, doubles(F.col("vec")), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)

    gaps = F.transform("centres", lambda c: F.struct(gap(c["centre"]).alias("gap"), c["centroid"].alias("centroid")))
    return rows.join(groups, "species").select("species", F.array_min(gaps)["centroid"].alias("centroid"), "vec")


def _lloyd(vectors: np.ndarray, n: int, iterations: int) -> np.ndarray:
    """Centres of k-means over a matrix whose first n rows are the start; ties go to the lower centre.

    A row keeps an upper bound of the distance to its centre and a lower bound of that to any other one; both follow
    the centres as they move, and only rows whose bounds meet are compared again.
    """
    centres = vectors[:n].copy()
    if len(centres) < n or n == 1:
        return centres if n > 1 else vectors.mean(0, keepdims=True)
    at = np.full(len(vectors), -1)
    upper, lower = np.full(len(vectors), np.inf), np.full(len(vectors), -np.inf)
    for _ in range(iterations):
        open_ = np.flatnonzero(upper >= lower * (1 - 1e-12) - 1e-12)  # rounding never hides a tie
        gaps = np.stack([((vectors[open_] - c) ** 2).sum(1) for c in centres], axis=1)
        at[open_] = gaps.argmin(1)
        two = np.sqrt(np.partition(gaps, 1, axis=1)[:, :2])
        upper[open_], lower[open_] = two[:, 0], two[:, 1]
        moved = centres.copy()
        for c in np.unique(at):  # a centre without rows stays
            moved[c] = vectors[at == c].mean(0)
        steps = np.sqrt(((moved - centres) ** 2).sum(1))
        still = np.abs(moved - centres).max()
        centres = moved
        upper += steps[at]
        lower -= steps.max()
        if still < 1e-9:
            break
    return centres


def _centroids_in_tasks(rows: DataFrame, n: int, iterations: int) -> DataFrame:
    """All rounds of a species in one task, whose vectors are together after one shuffle."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        by_start = pdf.sort_values(["_s", "_o"], kind="stable")
        centres = _lloyd(np.stack(by_start["vec"].to_numpy()).astype(np.float64), n, iterations)
        one = pdf["species"].iat[0]
        return pd.DataFrame({"species": [one] * len(centres), "centroid": np.arange(len(centres)), "centre": list(centres)})

    kind = rows.schema["species"].dataType.simpleString()
    return rows.groupBy("species").applyInPandas(solve, f"species {kind}, centroid int, centre array<double>")


def _centroids_in_rounds(rows: DataFrame, n: int, iterations: int) -> DataFrame:
    """One job for each round; the rows stay where they are and the centres travel."""
    start = top_rows(rows, ["species"], ["_s", "_o"], n)
    start = start.select(
        "species", (F.col("rank") - 1).cast("int").alias("centroid"), doubles(F.col("vec")).alias("centre")
    )
    centres = settle(start, "centres")
    if n == 1:
        iterations = 1
    for _ in range(iterations):
        means = mean_vector_by_group(_assign(rows, centres), ["species", "centroid"], "vec", "moved")
        step = F.aggregate(
            F.zip_with("centre", "moved", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: F.greatest(acc, x)
        )
        seen = Observation()
        both = centres.join(means, ["species", "centroid"], "left").select(
            "species", "centroid", "centre", F.coalesce("moved", "centre").alias("moved")
        )
        moved = settle(both.observe(seen, F.max(step).alias("step")), "centres")
        still = seen.get["step"]
        centres = moved.select("species", "centroid", F.col("moved").alias("centre"))
        if still < 1e-9:
            break
    return centres


def species_centroids(
    df: DataFrame, species: str, vec: str, order: str, n: int = 5, iterations: int = 20, start: Column | None = None,
    held_bytes: int = 64 << 20,
) -> DataFrame:
    """k-means inside every species at once: ``<species>, centroid, centre`` with at most n per species.

    A species with fewer rows than n has one centre per row. The starting centres are its first n rows by ``start``
    (by default a hash of ``order``) and then ``order``. Rows without a vector do not count. Vectors of a species that
    take at most ``held_bytes`` are shuffled once, and a task does all its rounds; those of a larger one stay spread, and
    each round sends the few centres to the rows and adds the rows up per centre before the shuffle. Both give the
    same centres up to rounding. Stops when nothing moves.
    """
    # the species travels in a struct, so that rows without one are a species like others
    known = df.where(F.col(vec).isNotNull())
    rows = known.select(
        F.struct(F.col(species).alias("of")).alias("species"),
        F.col(order).alias("_o"),
        (F.xxhash64(order) if start is None else start).alias("_s"),
        F.col(vec).alias("vec"),
    )
    rows = settle(rows, "rows")
    sizes = rows.groupBy("species").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"))
    large = settle(sizes.where(F.col("n") * F.col("width") * 8 > held_bytes).select("species"), "large")
    if large.isEmpty():
        centres = _centroids_in_tasks(rows.select("species.of", "_o", "_s", "vec").withColumnRenamed("of", "species"), n, iterations)
        return centres.select(F.col("species").alias(species), "centroid", "centre")
    small = rows.join(large, "species", "left_anti").select("species.of", "_o", "_s", "vec").withColumnRenamed("of", "species")
    centres = _centroids_in_rounds(rows.join(large, "species", "left_semi"), n, iterations).select("species.of", "centroid", "centre")
    both = centres.unionByName(_centroids_in_tasks(small, n, iterations).withColumnRenamed("species", "of"))
    return both.withColumnRenamed("of", species)
