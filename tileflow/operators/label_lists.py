"""Aggregation, voting and comparison of label lists, kept as rows until the lists are asked for.

Rows are ``(group, item)`` with one row per vote. Counting happens per ``(group, item)`` with partial
aggregation, so a group with very many votes reaches the next step as its few distinct items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.functions.lists import jaccard, jaccard_pick
from tileflow.operators.numbering import top_rows


def list_rows(df: DataFrame, keep: Sequence[str], col: str = "species_ids", item: str = "species_id") -> DataFrame:
    """One row per list element with its position from 0."""
    return df.select(*keep, F.posexplode(F.col(col)).alias("pos", item))


def collect_ranked(df: DataFrame, group: str, item: str, rank: str, out: str = "species_ids") -> DataFrame:
    """Rows with a rank -> one list per group, in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(item))))
    return df.groupBy(group).agg(F.transform(ordered, lambda e: e[item]).alias(out))


def list_union_distinct(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct union of the lists of a group, sorted."""
    unique = df.select(group, item).distinct()
    return unique.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("species_ids"))


def item_votes(df: DataFrame, group: str, item: str, order: Sequence[str]) -> DataFrame:
    """Votes per item in a group, with where the item was first seen in a stated row order."""
    seen = F.min(F.struct(*order)).alias("first_seen")
    return df.groupBy(group, item).agg(F.count("*").alias("votes"), seen)


def list_union_by_freq(
    df: DataFrame, group: str, item: str, order: Sequence[str], k: int | None = None
) -> DataFrame:
    """Items of a group by votes, then first appearance, then id: ``group, item, votes, rank``.

    ``k`` keeps the first k. Without it the ranks come from the position in the sorted list of the
    group's distinct items.
    """
    votes = item_votes(df, group, item, order)
    if k is not None:
        best = top_rows(votes, [group], [F.desc("votes"), "first_seen", item], k)
        return best.drop("first_seen")
    entry = F.struct((-F.col("votes")).alias("neg"), "first_seen", F.col(item))
    lists = votes.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("_items"))
    return lists.select(group, F.posexplode("_items").alias("_pos", "_item")).select(
        group,
        F.col(f"_item.{item}").alias(item),
        (-F.col("_item.neg")).alias("votes"),
        (F.col("_pos") + 1).alias("rank"),
    )


def vote_topk(
    tiles: DataFrame, group: str, tile: str, item: str, score: str, n: int = 1, k: int = 10
) -> DataFrame:
    """Majority vote: each tile votes for its n best items, the k items with most votes win.

    Ties go to the lower item id.
    """
    ballots = top_rows(tiles, [group, tile], [F.desc(score), item], n, "_place")
    votes = ballots.groupBy(group, item).agg(F.count("*").alias("votes"))
    return top_rows(votes, [group], [F.desc("votes"), item], k)


def distinct_items_overall(df: DataFrame, item: str) -> DataFrame:
    return df.select(item).distinct().agg(F.count(item).alias("n_items"))


def list_size_stats(df: DataFrame, col: str = "species_ids") -> DataFrame:
    size = F.size(F.col(col))
    return df.agg(
        F.count("*").alias("n_lists"),
        F.avg(size).alias("mean_size"),
        F.avg((size == 0).cast("int")).alias("empty_share"),
    )


def filter_impact_report(before: DataFrame, after: DataFrame, id_col: str, col: str = "species_ids") -> DataFrame:
    """List sizes before and after a filter in one row, and what the filter removed."""
    both = before.select(id_col, F.size(col).alias("b")).join(
        after.select(id_col, F.size(col).alias("a")), id_col, "inner"
    )
    parts: list[Column] = []
    for side, name in (("b", "before"), ("a", "after")):
        parts += [
            F.sum(side).alias(f"total_{name}"),
            F.avg(side).alias(f"mean_{name}"),
            F.min(side).alias(f"min_{name}"),
            F.max(side).alias(f"max_{name}"),
        ]
    removed = F.sum(F.col("b") - F.col("a"))
    return both.agg(
        *parts, removed.alias("removed"), F.try_divide(removed, F.sum("b")).alias("reduction")
    )


def _per_threshold(pairs: DataFrame, thresholds: Sequence[float], value) -> DataFrame:
    entries = [F.struct(F.lit(float(t)).alias("threshold"), value(float(t)).alias("value")) for t in thresholds]
    return pairs.select(F.inline(F.array(*entries)))


def jaccard_by_threshold(
    pairs: DataFrame, a: str, b: str, thresholds: Sequence[float]
) -> DataFrame:
    """Mean of the Jaccard scores that reach each threshold; 0 when none does."""
    scored = pairs.select(jaccard(F.col(a), F.col(b)).alias("score"))
    rows = _per_threshold(
        scored, thresholds, lambda t: F.when(F.col("score") >= t, F.col("score"))
    )
    return rows.groupBy("threshold").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_jaccard"))


def distinct_by_threshold(
    pairs: DataFrame, a: str, b: str, thresholds: Sequence[float]
) -> DataFrame:
    """Distinct species that the Jaccard ensemble yields at each threshold."""
    rows = _per_threshold(
        pairs, thresholds, lambda t: jaccard_pick(F.col(a), F.col(b), t)
    )
    items = rows.select("threshold", F.explode("value").alias("item")).distinct()
    return items.groupBy("threshold").agg(F.count("item").alias("n_species"))
