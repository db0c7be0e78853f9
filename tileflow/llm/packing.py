"""Packing of tokenised documents into windows of fixed length by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left is packed from long to short: a
segment tree over the remaining capacities of open windows finds the tightest one that still holds a piece. Pieces
are dealt over shards of some thousands by a hash of id and place, so each shard is one small task's work and wastes
about one window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tileflow.llm.bpe import IdRuns, Vocabulary
from tileflow.llm.folders import stored
from tileflow.llm.words import parts


class OpenWindows:
    """Open windows by remaining capacity; a segment tree knows which capacities are there."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.there = [0] * (2 * self.leaves)  # windows below each node
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        self._add(left, 1)

    def _add(self, left: int, change: int) -> None:
        i = left + self.leaves
        while i:
            self.there[i] += change
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the tightest window with room for ``size``; it is open no more."""
        i = size + self.leaves
        while not self.there[i]:
            while i & 1:  # a right child: the next larger capacities lie beside an ancestor
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            if not self.there[i]:
                i += 1
        left = i - self.leaves
        self._add(left, -1)
        return left, self.windows[left].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each size, given from large to small."""
    open_windows, out, made = OpenWindows(capacity), [], 0
    for size in sizes:
        found = open_windows.take(size)
        left, window = found or (capacity, made)
        made += found is None
        out.append((window, capacity - left))
        if left > size:
            open_windows.put(left - size, window)
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest."""
    return [(a, min(capacity, n - a)) for a in range(0, n, capacity)]


def _pieces(vocabulary, capacity: int, close: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = IdRuns(vocabulary.value)
        ending = np.array([close], "<u4").tobytes()
        for batch in parts(batches, "text"):
            row, start, length, crc, total = [], [], [], [], []
            ids, ends = coded(batch.column(1))
            ids = ids.astype("<u4", copy=False)
            for i, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                data = ids[first:last].tobytes() + ending
                n = last - first + 1
                for a, size in cut(n, capacity):
                    row.append(i)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * a : 4 * (a + size)]))
                    total.append(n)
            longs = [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            rows = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, *longs], names=["row", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int, close: int, id_col: str, text_col: str) -> DataFrame:
    """row (struct with id), start, length, ids_crc32, doc_tokens of every piece of every document."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    out = StructType([rows.schema["row"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        out = out.add(name, "long")
    return rows.mapInArrow(_pieces(vocabulary, capacity, close), out)


def _pack(capacity: int):
    """Rows in order of the shard, and in it from long to short; adds sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (s, n, batch, i)
            for batch in batches
            for i, (s, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
        )
        for shard, group in groupby(rows, key=lambda r: r[0]):
            members = list(group)
            placed = best_fit_decreasing([r[1] for r in members], capacity)
            at = 0
            for _, own in groupby(members, key=lambda r: id(r[2])):
                own = list(own)
                piece = own[0][2].slice(own[0][3], len(own))
                sequence = pa.array([(shard << 24) + w for w, _ in placed[at : at + len(own)]], pa.int64())
                offset = pa.array([o for _, o in placed[at : at + len(own)]], pa.int64())
                at += len(own)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[1:], sequence, offset], names=[*piece.schema.names[1:], "sequence_id", "offset"]
                )

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    close: int = 1,
    shard_rows: int = 4000,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long but the id).

    A document's tokens are the ids of its text and one ``close`` id; pieces of more than ``capacity`` are cut.
    ``shard_rows`` is how many pieces a shard holds on average. A shard that is four times as large, since very many
    pieces are equal in id, place and tokens, is dealt again by their numbers in the written table. Else the packing
    depends on the rows alone, not on how Spark has dealt them. Defined cases: a null or empty text is a document of
    one token; null ids, repeated ids and repeated rows are packed like others; a text of any length is cut into
    pieces by its one task; other columns are not read; an empty table gives no pieces.
    """
    pieces = token_pieces(docs, path, capacity, close, id_col, text_col).withColumn("no", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    shards = max(1, round(pieces.count() / shard_rows))
    shard = F.pmod(F.xxhash64("row.id", "start", "length", "ids_crc32"), F.lit(shards)).alias("shard")
    dealt = pieces.select(shard, "start", "length", "ids_crc32", "doc_tokens", "row", "no")
    large = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * shard_rows)
    large = stored(large, "large")
    if not large.isEmpty():
        again = F.pmod(F.xxhash64("no"), F.ceil(F.col("n") / shard_rows)) + 1
        dealt = dealt.join(large, "shard", "left").withColumn("shard", F.col("shard") + shards * F.coalesce(again, F.lit(0)))
    dealt = dealt.select("shard", "start", "length", "ids_crc32", "doc_tokens", "row").repartition("shard")
    dealt = dealt.sortWithinPartitions("shard", F.desc("length"), "row.id", "start", "ids_crc32")
    out = StructType([f for f in dealt.schema if f.name != "shard"]).add("sequence_id", "long").add("offset", "long")
    packed = dealt.mapInArrow(_pack(capacity), out)
    columns = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return packed.select(F.col("row.id").alias(id_col), *columns)
