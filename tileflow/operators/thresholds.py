"""Distance thresholds per image and over all images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.operators.numbering import top_rows
from tileflow.operators.quantiles import GATHER, countable, exact_percentiles, group_key


def min_of_medians(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, out: str = "min_med_distance"
) -> DataFrame:
    """Median per inner group, then the least median per outer group.

    An inner group is one tile's neighbours of one species, so it holds at most k values.
    """
    medians = df.groupBy(*inner).agg(F.median(value).alias("_median"))
    return medians.groupBy(*outer).agg(F.min("_median").alias(out))


def global_percentile(df: DataFrame, value: str, p: float) -> float | None:
    """Exact percentile of a column over all rows; pass a settled table."""
    row = exact_percentiles(df, [], value, [p]).first()
    return row["q0"] if row else None


def percentile_threshold_by_image(
    df: DataFrame, value: str, p: float = 0.1, by: str = "image_name", accuracy: int | None = None, gather: int = GATHER
) -> DataFrame:
    """Rows at or below the p-percentile of their image, with that value as ``threshold``.

    Percentiles are computed with images of more than ``gather`` rows split, and joined back, so that no image
    has to fit into one task. Rows whose value is null or nan do not count and are not kept; rows without an
    image are one image. ``accuracy`` takes the approximate percentile of that accuracy instead of the exact one.
    """
    known = df.where(countable(value))
    group = group_key([by])
    if accuracy:
        limits = known.groupBy(group.alias("_group")).agg(F.percentile_approx(value, p, accuracy).alias("threshold"))
    else:
        limits = exact_percentiles(known, [by], value, [p], gather).select("_group", F.col("q0").alias("threshold"))
    joined = known.withColumn("_group", group).join(limits, "_group")
    return joined.where(F.col(value) <= F.col("threshold")).select(*df.columns, "threshold")


def global_threshold_topn(
    df: DataFrame, value: str, p: float = 0.1, cap: int | None = 10,
    by: str = "image_name", tie: str = "species_id",
) -> DataFrame:
    """Rows at or below the p-percentile of all rows, then the ``cap`` best of each image."""
    limit = global_percentile(df, value, p)
    kept = df.where(F.col(value) <= F.lit(limit)).withColumn("threshold", F.lit(limit).cast("double"))
    return top_rows(kept, [by], [value, tie], cap) if cap else kept
