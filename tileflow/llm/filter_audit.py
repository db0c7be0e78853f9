"""Filter interaction audit: what each filter removes after each set of earlier filters, by relations of failing ids.

Every row gets a number when it is written, and each filter has one table of the numbers that fail it. What the filters
of a prefix leave does not depend on their order, so a prefix is a set. Starting from the failing rows of a filter, one
more earlier filter at a time is joined: left-anti gives what the filter still removes, left-semi what has become
redundant. All sets of one size are built by the same two joins, on filter and number, so no key is hot and the number of
joins follows the number of filters, not of orders. Survivors are the rows less what the steps so far remove; the ids
with a label come in by left-semi joins. Texts are read once; only small rows move.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tileflow.llm.folders import prepare, stored
from tileflow.llm.mixing import words_of


def repeats_smaller_id(rows: DataFrame) -> DataFrame:
    """The rows (row, id, text_hash, ...) whose hash a row with a smaller id has. Every task first reduces its rows of a
    hash to one; the rows of a text then meet them in a join that Spark can split."""
    first = rows.groupBy("text_hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return rows.join(first.select("text_hash", "first"), "text_hash").where("id > first").drop("first")


def failing_rows(judged: DataFrame, repeated: str | None) -> DataFrame:
    """(row, id, part, filter): the table of each filter is a folder of the written table."""
    columns = ["row", "id", "part"]
    failing = judged.select(*columns, F.explode("fails").alias("filter"))
    if repeated:
        found = repeats_smaller_id(judged.select(*columns, "text_hash"))
        failing = failing.unionByName(found.select(*columns, F.lit(repeated).alias("filter")))
    return stored(failing, "failing", by=("filter",))


def set_counts(failing: DataFrame, labelled: Mapping[str, DataFrame], filters: list[str]) -> DataFrame:
    """(part, filter, earlier, label, kind, n) for every filter and every set ``earlier`` of other filters, in order.

    Rows that fail ``filter``: of kind ``removed`` they fail none of the set, of kind ``out`` its last filter and none
    before it. The label is empty for all rows, else the name of a table of ids that holds theirs.
    """
    every = failing.withColumn("label", F.lit(""))
    for name, ids in labelled.items():
        every = every.unionByName(failing.join(ids, "id", "left_semi").withColumn("label", F.lit(name)))
    left = every.select("row", "part", "label", "filter", F.lit("").alias("earlier"))
    next_ids = failing.select(F.col("filter").alias("next"), "row")

    def counted(rows: DataFrame, kind: str) -> DataFrame:
        sums = rows.groupBy("part", "filter", "earlier", "label").agg(F.count(F.lit(1)).alias("n"))
        return sums.withColumn("kind", F.lit(kind))

    left = stored(left, "removed")
    counts = counted(left, "removed")
    for _ in filters[1:]:  # sets of 1, 2, ... filters, each from the set without its last one
        names = F.array(*map(F.lit, filters))
        later = F.filter(names, lambda f: (f != F.col("filter")) & (f > F.substring("earlier", -1, 1)))
        wider = left.withColumn("next", F.explode(later)).withColumn("earlier", F.concat("earlier", "next"))
        counts = counts.unionByName(counted(wider.join(next_ids, ["next", "row"], "left_semi"), "out"))
        left = stored(wider.join(next_ids, ["next", "row"], "left_anti").drop("next"), "removed")
        counts = counts.unionByName(counted(left, "removed"))
    return stored(counts, "counts")


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    repeated: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, each order of the filters and each step of it, zeros included. ``filters`` are named by one
    letter each and are conditions, true for rows that fail, on ``text`` (null is empty) and ``words``; ``repeated``
    names one more filter, which fails a text that a smaller id of the whole table has (told by sha256). ``labels`` has
    doc_id, quality (1: good) and toxic (1).

    Defined cases: a null part is the empty string; rows count one by one, also with a null or repeated id; rows without
    an id have no label and repeat nothing; an id has a label when one of its label rows says so; a condition that is
    null passes; an empty table has no part and gives an empty result; texts of any length are judged in their row;
    other columns are not looked at.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(text_col, F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("text"))
    named = F.array(*[F.when(condition, F.lit(name)) for name, condition in filters.items()])
    judged = base.withColumn("words", words_of(F.col("text"))).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "part",
        F.filter(named, lambda f: f.isNotNull()).alias("fails"),
        F.unhex(F.sha2("text", 256)).alias("text_hash"),
    )
    judged = stored(judged, "judged")
    names = sorted([*filters, *([repeated] if repeated else [])])
    ids = labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    labelled = {"good": ids.where("quality = 1").select("id"), "toxic": ids.where("toxic = 1").select("id")}
    counts = set_counts(failing_rows(judged, repeated), labelled, names)

    sets = [(f, "".join(s)) for f in names for k in range(len(names)) for s in combinations([x for x in names if x != f], k)]
    literal = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("earlier")) for f, s in sets])
    parts = stored(judged.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows")), "parts")
    asked = parts.select("part", "n_rows", F.explode(literal).alias("s")).select("part", "n_rows", "s.*")
    lengths = F.sequence(F.lit(0), F.length("earlier"))
    asked = asked.withColumn("sub", F.explode(F.transform(lengths, lambda k: F.substring("earlier", F.lit(1), k))))
    found = counts.withColumnRenamed("earlier", "sub")
    whole = F.col("sub") == F.col("earlier")

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    removed = (F.col("kind") == "removed") & whole
    per_set = asked.join(found, ["part", "filter", "sub"], "left").groupBy("part", "n_rows", "filter", "earlier").agg(
        total(removed & (F.col("label") == ""), "removed"),
        total((F.col("kind") == "out") & (F.col("label") == ""), "redundant"),
        total(removed & (F.col("label") == "good"), "good_lost"),
        total(removed & (F.col("label") == "toxic"), "toxic_lost"),
    )
    others = F.length("earlier") == len(names) - 1
    alone = F.max(F.when(others, F.col("removed"))).over(W.partitionBy("part", "filter"))
    per_set = per_set.withColumn("unique_fails", alone)

    steps = [
        ("".join(order), k + 1, order[k], "".join(sorted(order[:k]))) for order in permutations(names) for k in range(len(order))
    ]
    plan = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, earlier string")
    so_far = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return per_set.join(plan, ["filter", "earlier"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("n_rows") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        "redundant",
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )
