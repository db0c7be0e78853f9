"""Counts, profiles and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.operators.numbering import bounded_chunks
from tileflow.operators.quantiles import exact_percentiles, group_key


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group, largest first, then by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def top_n_groups(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The n most frequent groups; equal counts go by key."""
    return count_by(df, keys).limit(n)


def rarest_groups(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The end of the sorted counts: the n last rows of ``count_by``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy("n", *[F.desc(k) for k in keys]).limit(n)


def naive_baseline(train: DataFrame, test: DataFrame, k: int, id_col: str = "image_name") -> DataFrame:
    """The k most frequent species, as one list, for every test image."""
    top = top_n_groups(train, ["species_id"], k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "species_id")))
    ids = top.agg(F.transform(ordered, lambda e: e["species_id"]).alias("ids"))
    return test.select(F.col(id_col)).distinct().select(id_col, ids.scalar().alias("species_ids"))


def taxon_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev(value).alias("std"),
        F.count(value).alias("n"),
    )


def taxon_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def null_ratio_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of nulls per column, and of rows where all columns are null together."""
    flags = {c: F.col(c).isNull() for c in cols}
    together = F.lit(True)
    for flag in flags.values():
        together = together & flag
    return df.agg(
        *[F.avg(flag.cast("int")).alias(f"{c}_null_ratio") for c, flag in flags.items()],
        F.avg(together.cast("int")).alias("joint_null_ratio"),
    )


def nonnull_profile(df: DataFrame) -> DataFrame:
    """``column, non_null`` for every column."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "non_null")


def describe_cols(
    df: DataFrame, cols: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (), accuracy: int | None = None,
) -> DataFrame:
    """Count, mean, deviation, extremes and quantiles per column, overall or per group.

    Quantiles are exact, and ``df`` is read up to four times, so pass a table that is cheap to read; with ``accuracy``
    they are approximate (rank off by at most rows / accuracy) and all columns take one pass.
    """
    aggs: list[Column] = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_count"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
        if accuracy:
            aggs.append(F.percentile_approx(c, list(quantiles), accuracy).alias(f"_{c}_q"))
    out = df.groupBy(group_key(by).alias("_group")).agg(*aggs)
    names = [f"p{round(q * 100)}" for q in quantiles]
    if accuracy:
        for c in cols:
            out = out.withColumns({f"{c}_{n}": F.col(f"_{c}_q")[i] for i, n in enumerate(names)}).drop(f"_{c}_q")
    else:  # all columns at once: the column's name is part of the group
        values = [F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols]
        long = df.select(*by, F.explode(F.array(*values)).alias("_e")).select(*by, "_e.*")
        found = exact_percentiles(long, [*by, "_col"], "_x", quantiles)
        wide = [
            F.max(F.when(F.col("_group._col") == c, F.col(f"q{i}"))).alias(f"{c}_{n}")
            for c in cols
            for i, n in enumerate(names)
        ]
        key = F.struct(*[F.col(f"_group.{k}").alias(k) for k in by]) if by else group_key(by)
        out = out.join(found.groupBy(key.alias("_own")).agg(*wide), F.col("_group") == F.col("_own"), "left").drop("_own")
    return out.select(*[f"_group.{k}" for k in by], *[c for c in out.columns if c != "_group"])


def whisker_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Extremes, mean, deviation and the 5/25/50/75/95 % points of every metric per group."""
    return describe_cols(df, cols, (0.05, 0.25, 0.5, 0.75, 0.95), by)


def nunique_per_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct items per group; duplicates go first, so a large group costs only its distinct items."""
    return df.select(group, item).distinct().groupBy(group).agg(F.count(item).alias("n_items"))


def mean_nunique(df: DataFrame, group: str, item: str) -> DataFrame:
    counts = nunique_per_group(df, group, item)
    return counts.agg(F.count("*").alias("n_groups"), F.avg("n_items").alias("mean_items"))


def group_size_stats(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    return sizes.agg(
        F.count("*").alias("n_groups"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("mean_size"),
    )


def group_list(df: DataFrame, group: str, item: str, distinct: bool = True) -> DataFrame:
    """Members of each group as a sorted list; with ``distinct``, duplicates go before the shuffle."""
    rows = df.select(group, item)
    rows = rows.distinct() if distinct else rows
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))


def group_list_chunks(
    df: DataFrame, group: str, item: str, distinct: bool = True, size: int = 10_000
) -> DataFrame:
    """``group_list`` for groups of any size: ``group, chunk, items``, at most ``size`` members in a row.

    Chunks are numbered from 0 and the members are sorted across them. Nulls are no members; a group without members
    has no row.
    """
    rows = df.select(group, item).where(F.col(item).isNotNull())
    rows = bounded_chunks(rows.distinct() if distinct else rows, [group], [item], size)
    return rows.groupBy(group, "chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))


def crosstab_zero_filled(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` x ``column`` with 0 for absent pairs; ``values`` are the columns wanted."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def dominant_cluster(df: DataFrame, region: str, cluster: str) -> DataFrame:
    """The cluster with most rows in each region; ties go to the lowest cluster."""
    counts = df.groupBy(region, cluster).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(cluster).alias("cluster")))
    return counts.groupBy(region).agg(best.alias("best")).select(
        region, F.col("best.cluster").alias("dominant_cluster"), (-F.col("best.neg")).alias("n")
    )


def unmatched_regions(df: DataFrame, region: str) -> DataFrame:
    """Number of rows without a region."""
    return df.agg(F.count_if(F.col(region) == "").alias("unmatched"), F.count("*").alias("rows"))


def country_counts(occurrences: DataFrame, species: str = "species", country: str = "country") -> DataFrame:
    """Occurrences per species and country; a missing country counts as ``Unknown``."""
    named = F.coalesce(F.col(country), F.lit("Unknown"))
    return occurrences.groupBy(F.col(species).alias("species"), named.alias("country")).agg(
        F.count("*").alias("count")
    )


def country_rollup(counts: DataFrame) -> DataFrame:
    """Per species: its countries, how many, and all its occurrences."""
    per_country = counts.groupBy("species", "country").agg(F.sum("count").alias("count"))
    return per_country.groupBy("species").agg(
        F.array_sort(F.collect_list("country")).alias("countries"),
        F.count("*").alias("n_countries"),
        F.sum("count").alias("total_count"),
    )


def present_in(rollup: DataFrame, country: str) -> DataFrame:
    """How many species occur in a country."""
    hit = F.array_contains("countries", country)
    return rollup.agg(F.count_if(hit).alias("n_species"), F.count("*").alias("n_all"))


def coverage_ratio(stats: DataFrame, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Covered / total pixels overall or per group, largest first."""
    ratio = F.try_divide(F.sum(F.col("covered").cast("bigint")), F.sum(F.col("total").cast("bigint")))
    out = stats.groupBy(*by).agg(F.round(ratio, digits).alias("coverage"))
    return out.orderBy(F.desc("coverage"), *by)


def grid_coverage(counts: DataFrame) -> DataFrame:
    """Per grid size: all tiles, covered tiles and their ratio, from ``n, covered_tiles``."""
    tiles = F.col("n").cast("bigint") * F.col("n")
    return counts.groupBy("n").agg(
        F.sum(tiles).alias("total_tiles"),
        F.sum("covered_tiles").alias("covered_tiles"),
        F.try_divide(F.sum("covered_tiles"), F.sum(tiles)).alias("ratio"),
    )


def taxon_shrinkage(
    df: DataFrame, species: str, genus: str, family: str, value: str, strength: float = 10.0
) -> DataFrame:
    """Species means drawn towards the genus mean, and those towards the family mean.

    A level with n observed values keeps the weight ``n / (n + strength)``; a species without any
    value takes its genus (or family) estimate.
    """
    # Taxa travel as one value, so that a missing genus or family is a taxon like others in both joins.
    taxon = F.struct(F.col(family).alias("family"), F.col(genus).alias("genus"), F.col(species).alias("species"))
    sums = df.groupBy(taxon.alias("taxon")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"))
    sums = sums.select(
        "taxon", "s", "n", F.struct("taxon.family").alias("in_family"), F.struct("taxon.family", "taxon.genus").alias("in_genus")
    )
    genera = sums.groupBy("in_family", "in_genus").agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    families = genera.groupBy("in_family").agg(F.try_divide(F.sum("gs"), F.sum("gn")).alias("family_mean"))

    def shrink(total: str, n: str, parent: Column) -> Column:
        return (F.col(total) + strength * parent) / (F.col(n) + strength)

    genus_est = genera.join(families, "in_family").select(
        "in_genus", shrink("gs", "gn", F.col("family_mean")).alias("genus_estimate")
    )
    return sums.join(genus_est, "in_genus").select(
        F.col("taxon.species").alias(species), F.col("taxon.genus").alias(genus), F.col("taxon.family").alias(family),
        F.col("n"), shrink("s", "n", F.col("genus_estimate")).alias("estimate"),
    )
