"""Cleaning a corpus for training: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as Parquet into the
shared folder and gives the next stage what it reads back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.exact_dedup import drop_copies
from tileflow.llm.folders import prepare, stored
from tileflow.llm.jaccard_join import linked_groups
from tileflow.llm.language_id import LETTER, UNKNOWN, identify
from tileflow.llm.packing import pack_documents
from tileflow.llm.queries import documents, tokenizer_file
from tileflow.llm.substring_dedup import remove_repeats


def _beside(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` as columns and the others in a struct ``row``, so that no column clashes and none travels twice."""
    others = [c for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(F.lit(True).alias("_"), *others).alias("row"))


def _back(docs: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns as ``_beside`` has found them."""
    here = set(docs.columns)
    return docs.select(*[changed.get(c, F.col(c if c in here else f"row.`{c}`")).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language is found, those without a letter; a text of several languages stays.

    When there is nothing to learn from (score 0), all texts with letters stay. Null and empty texts go, rows with null
    or repeated ids are judged each by its text, texts of any length are labelled as a whole, and an empty table stays
    empty.
    """
    prepare(spark)
    named = identify(_beside(docs, "doc_id", "text", "lang"), training=F.lit(True))
    found = (F.col("lang_pred") != UNKNOWN) | (F.col("score") == 0)
    return _back(named.where(F.col("text").rlike(LETTER) & found), docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null is empty) one row stays, that with the smallest id.

    Exactly one stays also where ids repeat or are missing, and where whole rows repeat; a row with an id goes before
    those without. Texts of any length are compared as a whole; an empty table stays empty.
    """
    prepare(spark)
    return drop_copies(docs, keep="smallest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 on five-word shingles one stays.

    It is that with the smallest id, and a text with an id goes before those without. A row is known by its id and its
    text, so texts that share an id, or have none, are kept or dropped each for itself; rows equal in both stay or go
    together (64 bits of the text tell apart what shares an id). Texts without words are in no group and stay; an empty table stays empty.
    """
    prepare(spark)
    last = F.lit(2**63 - 1).cast("bigint")  # after all ids
    key = F.struct(F.coalesce("doc_id", last).alias("id"), F.xxhash64("text").alias("text")).alias("_key")
    groups = linked_groups(docs.select(key, "text"), id_col="_key", size=5, percent=80)
    gone = groups.where("component_id <> _key").select("_key").distinct()
    return docs.select("*", key).join(stored(gone, "gone"), "_key", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 35 words that occurs elsewhere go; other texts stay as they are, to the character.

    Null texts stay null, rows with null or repeated ids are treated by their text, whole rows that repeat are copies
    of each other; a text may be of any length; an empty table stays empty.
    """
    prepare(spark)
    stripped = remove_repeats(_beside(docs, "doc_id", "text"), window=35)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars"))
    return _back(stripped, docs.columns, **new)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in windows of 2,048.

    A null or empty text is one token; null and repeated ids and repeated rows are packed like others; a text of any
    length is cut into pieces; an empty table gives no pieces.
    """
    prepare(spark)
    return pack_documents(docs, tokenizer_file(), capacity=2048, close=1)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL expresses neither the language model nor the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
