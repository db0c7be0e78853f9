"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tileflow.sources.tables import settle

GATHER = 100_000  # values that one aggregate may hold
ACCURACY = 100_000  # of the sketch that brackets a rank


def group_key(by: Sequence[str]) -> Column:
    """The group as one value: null keys compare equal, and no keys means one group."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def countable(value: str) -> Column:
    """Neither null nor nan."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def share_rank(p: Column | float, n: Column) -> Column:
    """Rank of the smallest of n values that reaches the share p; p * n counts as whole when it is within 1e-9."""
    exact = (F.lit(p) if isinstance(p, float) else p) * n
    return F.greatest(F.ceil(F.round(exact, 9)), F.lit(1)).cast("bigint")


def _brackets(large: DataFrame, rows: DataFrame, points: Sequence[float], accuracy: int) -> DataFrame:
    """``_group, i, rank, low, high``: a range of values around each point, by a sketch that tasks fill and Spark merges.

    The sketch is off by at most a share 1 / accuracy of the rows, so two shares on either side leave room.
    """
    margin = 2 / accuracy
    shares = sorted({min(max(p + d, 0.0), 1.0) for p in points for d in (-margin, margin)})
    sketch = F.percentile_approx("x", shares, accuracy).alias("sketch")
    found = rows.join(large.select("_group"), "_group").groupBy("_group").agg(sketch).join(large, "_group")

    def bracket(i: int, p: float) -> Column:
        low = F.col("sketch")[shares.index(p - margin)] if p > margin else F.col("low")
        high = F.col("sketch")[shares.index(p + margin)] if p + margin < 1 else F.col("high")
        return F.struct(F.lit(i).alias("i"), share_rank(p, F.col("n")).alias("rank"), low.alias("low"), high.alias("high"))

    return found.select("_group", F.inline(F.array(*[bracket(i, float(p)) for i, p in enumerate(points)])))


def _ranked(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """``_group, i, q``: the value of the wanted rank, or no row where it is not inside the bracket.

    One pass counts the rows below each bracket and the values inside; tasks count before the shuffle, so a bracket
    costs as many rows as it has different values.
    """
    sides = F.collect_list(F.struct("i", "rank", "low", "high")).alias("sides")  # one for each point
    met = rows.join(brackets.groupBy("_group").agg(sides), "_group")
    met = met.select("_group", "x", F.explode(F.filter("sides", lambda b: F.col("x") <= b["high"])).alias("b"))
    inside = F.when(F.col("x") >= F.col("b.low"), F.col("x"))
    counts = met.groupBy("_group", "b.i", "b.rank", inside.alias("q")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("_group", "i").orderBy(F.asc_nulls_first("q")))
    placed = counts.withColumn("upto", upto).where("q is not null and rank <= upto and rank > upto - n")
    return settle(placed.select("_group", "i", "q"), "ranked")


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], gather: int = GATHER, accuracy: int = ACCURACY
) -> DataFrame:
    """``_group, q0, q1, ...``: per group the smallest value whose rank reaches each point's share.

    ``_group`` is ``group_key(by)``. Groups of up to ``gather`` rows are sorted as one array. In larger ones a mergeable
    sketch brackets each wanted rank, and an exact count of what lies below and inside the bracket finds the value, so
    there are three passes over the rows whatever the size of a group. A bracket holds about 4 / ``accuracy`` of its
    group's values; should one miss its rank, which the count shows, that point is counted over the whole group.
    Values keep their type. Nulls and nan do not count, whatever the size of a group. The rows are read more than
    once, so pass a table that is cheap to read, a settled one say.
    """
    rows = df.select(group_key(by).alias("_group"), F.col(value).alias("x")).where(countable("x"))
    sizes = rows.groupBy("_group").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    large = sizes.where(F.col("n") > gather)
    few = large.isEmpty()
    if few:
        small = rows
    else:
        large = settle(large, "large")
        small = rows.join(large.select("_group"), "_group", "left_anti")
    names = [f"q{i}" for i in range(len(points))]
    values = small.groupBy("_group").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    simple = values.select(
        "_group",
        *[F.element_at("xs", share_rank(float(p), F.size("xs")).cast("int")).alias(n) for p, n in zip(points, names)],
    )
    if few:
        return simple

    brackets = settle(_brackets(large, rows, points, accuracy), "brackets")
    found = _ranked(rows, brackets)
    missed = settle(brackets.join(found, ["_group", "i"], "left_anti"), "missed")
    if not missed.isEmpty():
        whole = missed.drop("low", "high").join(large.select("_group", "low", "high"), "_group")
        found = found.unionByName(_ranked(rows, whole))
    columns = [F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    return simple.unionByName(found.groupBy("_group").agg(*columns))
