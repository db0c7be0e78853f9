"""Exact duplicates: 128-bit content hash, one row stays per text, bytes compared inside each hash group.

DataFrame expressions only. Every task first reduces its own rows of a hash to one, so a text with any number
of copies sends one row per task; the rows of the documents then meet the small table of groups in a join that
Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.llm.folders import stored


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def content_hash(text: Column) -> Column:
    """128 bits in 16 bytes."""
    return F.unhex(F.md5(text))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` (long), ``kept`` and ``text_hash`` (binary) added.

    Texts are equal when their normalised bytes are. ``keep`` says whether the smallest or largest id of a group
    stays. Defined cases: a null text is the empty text; rows without an id count in ``group_size`` but stay only
    in a group where no row has one, and there all of them do; rows that repeat the id that stays are all
    ``kept``, since nothing tells them apart; an empty table gives an empty result; further columns pass through,
    and those called like an added column are replaced.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    added = ("keep_id", "group_size", "kept", "text_hash")
    docs = docs.drop(*added)
    text = normalise(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), hashed(text).alias("text_hash"))
    sizes = [best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # The least and the greatest text of a hash are one text exactly when no two texts share the hash.
    groups = stored(
        keyed.groupBy("text_hash")
        .agg(*sizes, (F.min("_text") != F.max("_text")).alias("mixed"))
        .where("mixed or group_size > 1"),
        "groups",
    )
    mixed = groups.where("mixed").select(F.col("text_hash").alias("_mixed_hash"))
    plain = groups.where("not mixed").select("text_hash", "keep_id", "group_size")
    rows = docs.withColumn("text_hash", hashed(text))
    if mixed.isEmpty():
        found = rows.join(plain, "text_hash", "left")
    else:  # texts that collide form groups of their own
        joined = keyed.join(mixed, F.col("text_hash") == F.col("_mixed_hash"), "left_semi")
        split = stored(joined.groupBy("text_hash", "_text").agg(*sizes), "collisions")
        both = plain.withColumn("_text", F.lit(None).cast("string")).unionByName(split)
        both = both.withColumnsRenamed({"text_hash": "_hash", "_text": "_whole"})
        marked = rows.join(mixed, F.col("text_hash") == F.col("_mixed_hash"), "left")
        own = F.when(F.col("_mixed_hash").isNotNull(), text)
        found = marked.join(both, (F.col("text_hash") == F.col("_hash")) & own.eqNullSafe(F.col("_whole")), "left")
    alone = F.col("group_size").isNull()
    out = found.withColumn("keep_id", F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")))
    return out.select(
        *docs.columns,
        "keep_id",
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("keep_id").eqNullSafe(F.col(id_col)).alias("kept"),
        "text_hash",
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Exactly one row of ``docs`` for each text, with all its columns as they are.

    It is the row with the smallest or largest id; a row without an id stays only where no row of the text has one, and
    rows of one id go by a hash of the row. Rows that repeat in all columns are reduced to one. Texts go through one
    shuffle for the groups, where each task first reduces its own, and, if the groups are too large for a broadcast,
    through one more.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    best, known = (F.min, F.col(id_col).isNull()) if keep == "smallest" else (F.max, F.col(id_col).isNotNull())
    text = normalise(F.col(text_col))
    place = F.struct(known.alias("a"), F.col(id_col).alias("b"), F.xxhash64(*docs.columns).alias("c"))
    keyed = docs.select(hashed(text).alias("hash"), text.alias("text"), place.alias("place"))
    groups = keyed.groupBy("hash").agg(
        best("place").alias("best"), F.count(F.lit(1)).alias("n"), (F.min("text") != F.max("text")).alias("mixed")
    )
    groups = stored(groups.where("mixed or n > 1"), "groups")
    whole = docs.select(F.struct(*docs.columns).alias("row"), hashed(text).alias("hash"), place.alias("place"))
    if groups.where("mixed").isEmpty():
        found = whole.join(groups.select("hash", "best"), "hash", "left")
    else:  # texts that collide form groups of their own
        mixed = groups.where("mixed").select("hash")
        split = keyed.join(mixed, "hash", "left_semi").groupBy("hash", "text").agg(best("place").alias("best"))
        plain = groups.where("not mixed").select("hash", F.lit(None).cast("string").alias("own"), "best")
        both = plain.unionByName(stored(split, "collisions").withColumnRenamed("text", "own"))
        marked = whole.join(mixed.withColumn("two", F.lit(True)), "hash", "left")
        own = F.when(F.col("two"), normalise(F.col("row").getField(text_col)))
        both = both.withColumnsRenamed({"hash": "_hash", "own": "_own"})
        found = marked.join(both, (F.col("hash") == F.col("_hash")) & own.eqNullSafe(F.col("_own")), "left")
    kept = found.where(F.col("best").isNull() | F.col("place").eqNullSafe(F.col("best"))).select("row", "hash", "place")
    twice = keyed.groupBy("hash", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = stored(twice.select(F.col("hash").alias("_hash"), F.col("place").alias("_place")), "repeats")
    if twice.isEmpty():
        return kept.select("row.*")
    # rows that repeat in all columns: their hashes are the same, so all of them or none are here
    there = (F.col("hash") == F.col("_hash")) & F.col("place").eqNullSafe(F.col("_place"))
    rest = kept.join(twice, there, "left_anti").select("row")
    one = kept.join(twice, there, "left_semi").groupBy("hash", "place").agg(F.first("row").alias("row"))
    return rest.unionByName(one.select("row")).select("row.*")
