"""Mix sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded choice of blocks.

Every source gets a target, the number of tokens that the mix takes from it. Targets become whole blocks: the source with
the highest quotient of target and next odd number gets the next block, until all are given. Each source's documents are
dealt to shards of bounded size by a seeded hash, and its blocks are apportioned to its shards in the same way. A shard
lays its documents in a line in seeded order and cuts it into blocks; a quota above the number of blocks takes the whole
line once (or more often) and the rest by seeded rank. DataFrame expressions only: texts are read once for their length
and hash, and then only small rows move, those of a source spread over its shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tileflow.llm.folders import prepare, stored
from tileflow.operators.numbering import dense_row_id, row_number_by_key

SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def apportion(cells: DataFrame, group: str, order: str, weight: str, seats: str, name: str = "quota") -> DataFrame:
    """Adds ``name``: the ``seats`` of each group given to its cells by highest quotients weight / (2 quota + 1).

    Cells are (group, order) with a weight of 0 or more; ``seats`` is the same in all rows of a group. Ties go to the
    lower order. Rounded exact shares are at most half a seat per cell off, so only the seats that are missing or too
    many are decided by quotient; a cell gains or loses at most its share of (missing + cells) and one of them.
    """
    total = cells.groupBy(F.col(group).alias("_g")).agg(F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_cells"))
    share = F.coalesce(F.col(weight) * F.col(seats) / F.when(F.col("_total") > 0, F.col("_total")), F.lit(0.0))
    based = cells.join(total, F.col(group) == F.col("_g")).drop("_g").withColumn("_share", share)
    based = stored(based.withColumn("_base", F.floor(F.col("_share") + 0.5)), "shares")
    off = based.groupBy(F.col(group).alias("_g")).agg((F.max(seats) - F.sum("_base")).alias("_off"))
    open_ = based.join(off, F.col(group) == F.col("_g")).where("_off <> 0 and _total > 0")
    most = F.floor(F.col("_share") * (F.abs("_off") + F.col("_cells")) / F.col(seats)) + 2
    most = F.when(F.col("_off") < 0, F.least(most, F.col("_base"))).otherwise(most)
    next_ = F.col("_base") + F.when(F.col("_off") > 0, F.col("_k")).otherwise(-F.col("_k") - 1)
    gains = (
        open_.where(most > 0)
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), most - 1)))
        .withColumn("_sign", F.signum("_off").cast("bigint"))
        # the highest quotients gain a seat, the lowest lose one
        .select(group, order, "_sign", (F.col(weight) / (2 * next_ + 1) * -F.col("_sign")).alias("_rank"), F.abs("_off").alias("_off"))
        .withColumn("_tie", F.col(order) * F.col("_sign"))
    )
    ranked = row_number_by_key(gains, [group], ["_rank", "_tie"], "_row").where("_row <= _off")
    moved = ranked.groupBy(F.col(group).alias("_g"), F.col(order).alias("_o")).agg(F.sum("_sign").alias("_moved"))
    out = based.join(moved, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_o")), "left")
    quota = F.col("_base") + F.coalesce("_moved", F.lit(0))
    return out.select(*cells.columns, quota.cast("bigint").alias(name))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``number``, ``source``, ``source_size``, ``target`` of sizes (source, source_size).

    Sources in order (null last) have the weights in turn and divide ``share`` of all tokens; a target stops at
    ``most`` times its source's size, and what it leaves is divided again by weight until none is above. Each round
    is one sum over the sources; only two totals come to the driver.
    """
    numbered = dense_row_id(sizes, [F.asc_nulls_last("source")], "number")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = stored(numbered.withColumn("weight", turn.cast("bigint")).withColumn("cap", F.col("source_size") * most), "sources")
    total, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, before = (total or 0) * share, 0.0, -1
    open_weight, capped = all_weight or 0, 0
    while open_weight and open_weight != before:
        before, level = open_weight, max(total - capped, 0) / open_weight  # tokens for a weight of 1
        full = F.col("cap") < F.col("weight") * level
        sums = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        capped, open_weight = sums[0] or 0, sums[1] or 0
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level) if open_weight else F.col("cap").cast("double")
    return table.select("number", "source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = 16,
    shard: int = 1 << 22,
    seed: int = 0,
) -> DataFrame:
    """id, ``source``, ``size``, ``source_size``, ``target``, ``passes``, ``spans``, ``taken``: one row for each row of ``docs``.

    The mix takes a document's words ``passes`` times as a whole and then the spans (start, length), in all ``taken``
    words, at most ``most`` times its size. ``taken_text`` gives them. What a source gives differs from its target by
    about a block, and by at most a block more for each of its shards.

    Defined cases: null, empty and blank texts have size 0 and give nothing; a null source is a source, the last; rows
    with a null or repeated id are placed by id and text; rows that are equal in both lie one after the other, so
    reruns give the same rows; texts of any length are cut into blocks like others (a text is one row in its shard,
    its blocks are rows of that task); an empty table gives an empty result; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(text_col, F.lit(""))))
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.size(words_of(F.col(text_col))).cast("bigint").alias("size"),
            F.md5(key).alias("place"),
        ),
        "sizes",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    wanted = targets.agg(F.sum("target")).first()[0] or 0
    seats = targets.withColumn("all", F.lit(0)).withColumn("seats", F.lit(round(wanted / block)).cast("bigint"))
    sources = stored(apportion(seats, "all", "number", "target", "seats"), "quotas")
    sources = sources.select("number", F.col("source").alias("name"), "source_size", "target", F.col("quota").alias("source_quota"))

    known = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    shards = F.ceil(F.col("source_size") / shard)
    own_shard = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") % shards
    filled = known.where("size > 0").withColumn("shard", own_shard)
    cells = filled.groupBy("number", "shard").agg(F.sum("size").alias("length"), F.max("source_quota").alias("seats"))
    blocks = F.ceil(F.col("length") / block)
    quotas = apportion(stored(cells, "cells"), "number", "shard", "length", "seats")
    quotas = quotas.withColumn("quota", F.least("quota", blocks * most))
    quotas = quotas.select(
        "number", "shard", F.floor(F.col("quota") / blocks).alias("passes"), (F.col("quota") % blocks).alias("extra")
    )

    line = W.partitionBy("number", "shard").orderBy("place", "id", "size")
    start = F.coalesce(F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = filled.join(quotas, ["number", "shard"]).withColumn("start", start)
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block), F.floor((end - 1) / block)
    cut = placed.withColumn("block", F.explode(F.when(F.col("extra") > 0, F.sequence(first, last)).otherwise(F.array(first))))
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("number"), F.col("shard"), F.col("block")))
    drawn = cut.withColumn("rank", F.dense_rank().over(W.partitionBy("number", "shard").orderBy(lot, "block")))
    begin = F.greatest(F.col("block") * block, F.col("start"))
    length = F.least((F.col("block") + 1) * block, end) - begin
    chosen = F.col("rank") <= F.col("extra")
    span = F.when(chosen, F.struct((begin - F.col("start")).alias("start"), length.alias("length")))
    kept = ["source", "source_size", "target", "passes"]
    mixed = drawn.groupBy("number", "shard", "start", "size", "id").agg(
        *[F.first(c).alias(c) for c in kept],
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.coalesce(F.sum(F.when(chosen, length)), F.lit(0)).alias("more"),
    )
    named = ["source", "size", "source_size", "target", "passes", "spans", "taken"]
    mixed = mixed.withColumn("taken", F.col("passes") * F.col("size") + F.col("more"))
    none = F.array().cast("array<struct<start: bigint, length: bigint>>")
    empty = known.where("size = 0").select("*", F.lit(0).cast("bigint").alias("passes"), none.alias("spans"))
    empty = empty.withColumn("taken", F.lit(0).cast("bigint"))
    both = [x.select(F.col("id").alias(id_col), *named) for x in (mixed, empty)]
    return both[0].unionByName(both[1])


def taken_text(text: Column, passes: Column, spans: Column) -> Column:
    """The words that a mix takes of a text, joined by single spaces."""
    words = words_of(text)
    pieces = F.transform(spans, lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.concat(F.flatten(F.array_repeat(words, passes.cast("int"))), F.flatten(pieces)), " ")
