"""Morphology profiles of a table of masks as a job that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.operators.raster import morph_profile_arrays
from tileflow.operators.shaping import hash_bucket
from tileflow.sources.writers import write_pending_buckets


def profile_masks(
    masks: DataFrame, path: str, buckets: int = 20, maximum: int = 100, step: int = 10, swapped: bool = False,
    ids: Sequence[str] | None = None, key: str = "image_name", bucket: str = "sample_id", tasks: int | None = None,
) -> list[int]:
    """Write ``<mask>_stats`` arrays of all mask columns to ``path``, in folders by the bucket of ``key``.

    Runs the buckets that are not finished yet, all in one pass, and returns them; a second call has nothing to do.
    ``ids`` are the columns to keep, by default all without ``mask`` in their name. A column called like ``bucket``
    in ``masks`` is replaced. ``tasks`` spreads the masks before they are measured, for tables that are small in bytes
    and have few input splits; a null mask gives a null array, a null key is a key like others.
    """
    rows = masks.drop(bucket)
    kept = list(ids or [c for c in rows.columns if "mask" not in c])
    wanted = [*kept, *[c for c in rows.columns if "mask" in c and c not in kept]]
    number = hash_bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), buckets)
    rows = rows.select(*wanted, number.alias(bucket))

    def measured(pending: DataFrame) -> DataFrame:
        spread = pending.repartition(tasks) if tasks else pending
        return morph_profile_arrays(spread, [*kept, bucket], maximum, step, swapped)

    return write_pending_buckets(rows, bucket, buckets, measured, path)
