"""Nearest neighbours and distance tables over vectors that stay distributed.

Vectors travel in blocks (ids and one binary matrix per row), so that a join pairs whole blocks and
each pair is one matrix product. Distances are those of L2-normalised vectors.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tileflow.functions.vectors import doubles
from tileflow.operators.numbering import top_rows
from tileflow.sources.tables import new_path, settle

_BLOCK_BYTES = 8 << 20  # matrix bytes in one block
_BLOCK_ROWS = 4096
_PACK_ROWS = 1024  # queries that travel together
_PIVOT_BYTES = 32 << 20  # all upper pivots together; tasks and the driver hold them
_ONE_LEVEL = 64  # up to this many pivots need no upper ones
_CHUNK_LEAVES = 1024  # lower pivots in one row of the table
_PART_WIDTH = 4  # numbers of a vector that one byte of its code stands for
_BOOK_SAMPLE = 16_384  # vectors that code books are fitted to
_HELD_BYTES = 64 << 20  # vectors in open blocks of one task
_ONE_ROUND = 4  # up to this many cells are searched at once
_KEYS_PER_TASK = 4  # join keys wanted per task
_OPEN_PACKS = 64  # packs of queries whose best neighbours a task holds
_SLICE_ROWS = 512  # queries compared with a block at a time
_GAP_BYTES = 4 << 20  # distances of a slice of queries to a block
_SLOT_BLOCKS = 16  # blocks of one cell that share a join key
_COPY_BYTES = 256 << 20  # copies of an index's blocks that may be made for more join keys
_FEW_COPIES = 8  # so many lower pivots a query may ask on average and still be sent to each
_FEW_SHARE = 1 / 128  # and this share of them; above it, comparing with all blocks takes less time
_ROUTED_BYTES = 32 << 20  # queries are sent in any case while their copies have no more bytes
_ASKED_SAMPLE = 64  # queries that tell how many lower pivots are asked
_SCAN_ROWS = 2048  # queries in a pack that meets all blocks
_SCAN_BYTES = 32 << 20  # queries that a task holds beside all blocks
_CELLS_PER_CORE = 2  # join keys where all packs meet all blocks
_EXACT_PAIRS = 8192  # pairs whose exact distance is taken at once


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v) for v in vectors])


def _from_bytes(data: bytes, rows: int, dtype: str) -> np.ndarray:
    """Unit vectors in double precision from a packed block."""
    return _unit(np.frombuffer(data, dtype=dtype).reshape(rows, -1).astype(np.float64))


def _element(df: DataFrame, vec: str) -> str:
    element = df.schema[vec].dataType.elementType
    return "float32" if isinstance(element, T.FloatType) else "float64"


def _rows_per_block(width: int, dtype: str) -> int:
    return max(1, min(_BLOCK_ROWS, _BLOCK_BYTES // (width * np.dtype(dtype).itemsize)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of unit (or zero) vectors.

    Rounded to 12 digits: equal vectors are then equally far, whichever blocks they came in.
    """
    squares = a @ b.T
    squares *= -2.0
    squares += (a * a).sum(1)[:, None]
    squares += (b * b).sum(1)[None, :]
    np.round(squares, 12, out=squares)
    return np.maximum(squares, 0.0, out=squares)


def _k_smallest(found: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest entries of each row, ascending; ties go to the first column."""
    if found.shape[1] <= k:
        return np.argsort(found, axis=1, kind="stable")
    best = np.argpartition(found, k - 1, axis=1)[:, :k]
    kth = np.take_along_axis(found, best, 1).max(1, keepdims=True)
    tied = (found <= kth).sum(1) > k
    best[tied] = np.argsort(found[tied], axis=1, kind="stable")[:, :k]
    best.sort(axis=1)
    order = np.argsort(np.take_along_axis(found, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


# ---------------------------------------------------------------------------------------------------
# The index: a tree of two levels of pivots, and blocks of vectors around the lower ones


@dataclass(frozen=True)
class VectorIndex:
    """Vectors grouped around pivots and written as blocks; all but the upper pivots are tables.

    ``blocks``: block, upper, leaf, n, nearest, farthest, ids, data and, if asked for, codes. ``leaves``: the lower
    pivots of an upper one in chunks, with what is known of their vectors. ``centres``, ``near``, ``far`` and ``held``:
    the upper pivots, the radii around them and the number of vectors. ``books``: the code books of the codes, ``probes``:
    how many upper pivots, and lower ones below each, hold the neighbours with the recall asked for.
    """

    path: str
    blocks: DataFrame
    leaves: DataFrame
    centres: np.ndarray
    near: np.ndarray
    far: np.ndarray
    held: np.ndarray
    n_leaves: int
    n_slots: int
    dtype: str
    books: np.ndarray | None = None
    probes: tuple[int, int] | None = None


def _first_vectors(source: DataFrame, n: int, salt: str) -> np.ndarray:
    """Unit vectors of the first n rows in hash order; the same data gives the same rows."""
    rows = source.orderBy(F.xxhash64(F.lit(salt), "id"), "id").limit(n).select("vec").toPandas()
    return _unit(_matrix(rows["vec"]).astype(np.float64))


def _pivot_table(source: DataFrame, centres: np.ndarray, share: float) -> tuple[DataFrame, np.ndarray]:
    """(upper, chunk, leaf, vec) of the lower pivots, and the number of chunks of every upper pivot.

    Lower pivots are the upper ones and, below each, the vectors nearest to it among a share of all vectors.
    """
    spark = source.sparkSession
    own = pd.DataFrame({"upper": np.arange(len(centres), dtype=np.int32), "vec": [c.tobytes() for c in centres]})
    table = spark.createDataFrame(own, "upper int, vec binary")
    if not share:
        return table.select("upper", F.lit(0).alias("chunk"), F.col("upper").cast("bigint").alias("leaf"), "vec"), np.ones(len(centres), int)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = _unit(_matrix(pdf["vec"]).astype(np.float64))
                upper = _distances(units, centres).argmin(1).astype(np.int32)
                yield pd.DataFrame({"upper": upper, "vec": [u.tobytes() for u in units]})

    lot = F.pmod(F.xxhash64(F.lit("leaf"), "id"), F.lit(1 << 30))
    drawn = source.where(lot < F.lit(int(share * (1 << 30)))).mapInPandas(nearest, "upper int, vec binary")
    table = table.unionByName(drawn).distinct().withColumn("leaf", F.monotonically_increasing_id())
    table = settle(table, "pivots")
    sizes = table.groupBy("upper").agg(F.ceil(F.count("*") / _CHUNK_LEAVES).cast("int").alias("chunks"))
    chunks = np.ones(len(centres), int)
    for upper, n in sizes.where("chunks > 1").collect():  # upper pivots only
        chunks[upper] = n
    return table.join(sizes, "upper").withColumn("chunk", (F.col("leaf") % F.col("chunks")).cast("int")).drop("chunks"), chunks


def _chunked(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row for a chunk of at most about ``_CHUNK_LEAVES`` lower pivots, its columns as arrays."""
    rows = table.groupBy("upper", "chunk").agg(F.sort_array(F.collect_list(F.struct("leaf", *columns))).alias("p"))
    return rows.select("upper", "chunk", *[F.col(f"p.{c}").alias(c) for c in ("leaf", *columns)])


def _code_books(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Code books (part, code, width of a part) by k-means in each part of the vectors; zeros fill the last part."""
    parts = -(-sample.shape[1] // _PART_WIDTH)
    padded = np.pad(sample, ((0, 0), (0, parts * _PART_WIDTH - sample.shape[1]))).reshape(len(sample), parts, _PART_WIDTH)
    books = np.zeros((parts, min(256, len(sample)), _PART_WIDTH), dtype=np.float32)
    for p in range(parts):
        x = padded[:, p].astype(np.float32)
        book = x[: books.shape[1]].copy()
        for _ in range(rounds):
            at = ((book * book).sum(1)[None, :] - 2 * x @ book.T).argmin(1)
            sums = np.stack([np.bincount(at, x[:, j], len(book)) for j in range(_PART_WIDTH)], axis=1)
            n = np.bincount(at, minlength=len(book))
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book).astype(np.float32)
        books[p] = book
    return books


def _encode(units: np.ndarray, books: np.ndarray) -> np.ndarray:
    """One byte for each part of each vector."""
    parts, _, width = books.shape
    padded = np.pad(units, ((0, 0), (0, parts * width - units.shape[1]))).astype(np.float32).reshape(len(units), parts, width)
    codes = [((b * b).sum(1)[None, :] - 2 * padded[:, p] @ b.T).argmin(1) for p, b in enumerate(books)]
    return np.stack(codes, axis=1).astype(np.uint8)


def _decode(codes: bytes, n: int, books: np.ndarray) -> np.ndarray:
    """What codes stand for: one look-up in the books for each part."""
    table = np.frombuffer(codes, dtype=np.uint8).reshape(n, len(books))
    return np.concatenate([books[p][table[:, p]] for p in range(len(books))], axis=1)


def build_index(
    df: DataFrame, id_col: str, vec: str, pivots: int | None = None, path: str | None = None, codes: bool = False,
    k: int = 10, recall: float = 0.95,
) -> VectorIndex:
    """Write the vectors of ``df`` as blocks, each block holding vectors closest to one lower pivot.

    There is about one lower pivot for every block of vectors (or ``pivots``), a table of any size. Up to 64 of them are
    a single level; above, the square root of their number are upper pivots, which tasks and the driver hold (at most
    32 MB). A vector goes to its nearest upper pivot, meets the lower pivots below it in a join, and is packed into
    blocks behind a shuffle that Spark rebalances, so a pivot that attracts very many vectors only has more blocks.
    ``codes`` adds product-quantised codes, whose books are fitted to at most 16,384 vectors, and the number of probes
    that ``recall`` of ``k`` neighbours takes (``measure_probes``), measured once and kept with the index.
    """
    spark = df.sparkSession
    dtype = _element(df, vec)
    source = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).where("vec is not null")
    n, width = source.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("the index has no vectors")
    wanted = pivots or max(1, n // _BLOCK_ROWS)
    uppers = wanted if wanted <= _ONE_LEVEL else min(int(np.ceil(wanted**0.5)), max(1, _PIVOT_BYTES // (8 * width)))
    sample = _first_vectors(source, max(uppers, _BOOK_SAMPLE if codes else 0), "upper")
    centres, books = sample[:uppers], _code_books(sample) if codes else None
    lower, chunks = _pivot_table(source, centres, max(0, wanted - uppers) / n)
    size, id_type = _rows_per_block(width, dtype), source.schema["id"].dataType.simpleString()

    def to_uppers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packs = []
            raw = _matrix(pdf["vec"]).astype(dtype) if len(pdf) else np.empty((0, 1))
            for first in range(0, len(raw), _SLICE_ROWS):
                part, ids = raw[first : first + _SLICE_ROWS], pdf["id"].to_numpy()[first : first + _SLICE_ROWS]
                gaps = _distances(_unit(part.astype(np.float64)), centres)
                best = gaps.argmin(1)
                for u in np.unique(best):
                    rows = np.flatnonzero(best == u)
                    chunk = zlib.crc32(str(ids[rows[0]]).encode()) % chunks[u]
                    reach = np.sqrt(gaps[rows, u])
                    packs.append({"upper": u, "chunk": chunk, "ids": ids[rows], "reach": reach, "data": part[rows].tobytes()})
            if packs:
                yield pd.DataFrame(packs)

    def nearest_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for row in pdf.itertuples():
                raw = np.frombuffer(row.data, dtype=dtype).reshape(len(row.ids), -1)
                leaves = np.frombuffer(b"".join(row.vec)).reshape(len(row.leaf), -1)
                gaps = _distances(_unit(raw.astype(np.float64)), leaves)
                best = gaps.argmin(1)
                yield {
                    "upper": row.upper,
                    "leaf": np.asarray(row.leaf)[best],
                    "id": row.ids,
                    "radius": np.sqrt(gaps[np.arange(len(best)), best]),
                    "reach": row.reach,
                    "data": [r.tobytes() for r in raw],
                }

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _joined(nearest_leaves(batches))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(leaf: int, rows: pd.DataFrame) -> dict:
            data = b"".join(rows["data"])
            coded = _encode(_from_bytes(data, len(rows), dtype), books).tobytes() if books is not None else None
            out = {"upper": rows["upper"].iat[0], "leaf": leaf, "n": len(rows)}
            out |= {"nearest": rows["radius"].min(), "farthest": rows["radius"].max()}
            out |= {"low": rows["reach"].min(), "high": rows["reach"].max()}
            return out | {"ids": rows["id"].to_numpy(), "data": data, "codes": coded}

        yield from _gathered(batches, "leaf", size, max(1, _HELD_BYTES // (width * np.dtype(dtype).itemsize)), block)

    met = source.mapInPandas(to_uppers, f"upper int, chunk int, ids array<{id_type}>, reach array<double>, data binary")
    met = met.join(_chunked(lower, ["vec"]), ["upper", "chunk"])
    dealt = met.mapInPandas(to_leaves, f"upper int, leaf bigint, id {id_type}, radius double, reach double, data binary")
    schema = (
        "upper int, leaf bigint, n int, nearest double, farthest double, low double, high double, "
        f"ids array<{id_type}>, data binary, codes binary"
    )
    path = path or new_path(spark, "index")
    blocks = dealt.hint("rebalance", "leaf").mapInPandas(pack, schema).withColumn("block", F.monotonically_increasing_id())
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.schema(f"{schema}, block bigint").parquet(f"{path}/blocks")

    known = blocks.groupBy("leaf").agg(
        F.min("nearest").alias("nearest"),
        F.max("farthest").alias("farthest"),
        F.sum("n").alias("n"),
        F.ceil(F.count("*") / _SLOT_BLOCKS).alias("slots"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    full = lower.join(known, "leaf")
    chunked = _chunked(full, ["vec", "nearest", "farthest", "n", "slots", "low", "high"])
    chunked.write.mode("overwrite").parquet(f"{path}/leaves")
    leaves = spark.read.schema(chunked.schema).parquet(f"{path}/leaves")
    sums = [F.min(F.array_min("low")), F.max(F.array_max("high"))]
    sums += [F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)) for c in ("n", "slots")] + [F.sum(F.size("leaf"))]
    near, far, held = (np.zeros(len(centres)) for _ in range(3))
    n_slots = n_leaves = 0
    for upper, low, high, rows, slots, below in leaves.groupBy("upper").agg(*sums).collect():  # upper pivots only
        near[upper], far[upper], held[upper] = low, high, rows
        n_slots, n_leaves = n_slots + slots, n_leaves + below
    index = VectorIndex(path, blocks, leaves, centres, near, far, held, n_leaves, n_slots, dtype, books)
    if codes:
        index = replace(index, probes=measure_probes(index, source, k, recall))
    kept = pickle.dumps({f.name: getattr(index, f.name) for f in fields(index) if f.name not in ("path", "blocks", "leaves")})
    spark.createDataFrame([(bytearray(kept),)], "kept binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
    return index


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` has written to ``path``."""
    kept = pickle.loads(bytes(spark.read.parquet(f"{path}/tree").first()["kept"]))
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("blocks", "leaves")}
    return VectorIndex(path=path, **tables, **kept)


def _joined(frames: Iterator[dict], rows: int = 8192) -> Iterator[pd.DataFrame]:
    """Columns of many small frames in frames of about ``rows`` rows; scalars hold for a whole small frame."""
    held: list[dict] = []
    count = 0

    def close() -> pd.DataFrame:
        return pd.concat([pd.DataFrame(f) for f in held], ignore_index=True)

    for frame in frames:
        held.append(frame)
        count += max((len(c) for c in frame.values() if isinstance(c, (np.ndarray, list))), default=1)
        if count >= rows:
            yield close()
            held, count = [], 0
    if held:
        yield close()


def _gathered(batches: Iterator[pd.DataFrame], key: str, size: int, most: int, closed: Callable) -> Iterator[pd.DataFrame]:
    """Rows of one key in one output row of at most ``size``; with ``most`` rows held, the fullest key is closed."""
    held: dict = {}
    counts: dict = {}
    waiting = 0

    def take(k) -> list[dict]:
        nonlocal waiting
        rows = pd.concat(held.pop(k)) if len(held[k]) > 1 else held.pop(k)[0]
        waiting -= counts.pop(k)
        return [closed(k, rows.iloc[i : i + size]) for i in range(0, len(rows), size)]

    for pdf in batches:
        out = []
        for k, rows in pdf.groupby(key, sort=False):
            held.setdefault(k, []).append(rows)
            counts[k] = counts.get(k, 0) + len(rows)
            waiting += len(rows)
            if counts[k] >= size:
                out += take(k)
        while waiting > most:
            out += take(max(counts, key=counts.get))
        if out:
            yield pd.DataFrame(out)
    while held:
        yield pd.DataFrame([row for k in list(held)[:_OPEN_PACKS] for row in take(k)])


# ---------------------------------------------------------------------------------------------------
# Search


def _within(least: np.ndarray, most: np.ndarray, held: np.ndarray, limits: np.ndarray, k: int) -> np.ndarray:
    """Which cells may hold one of the k nearest: no vector of a cell is nearer than ``least`` or farther than ``most``.

    The k-th neighbour is not beyond ``limits``, nor beyond the cells that hold k vectors when taken by ``most``.
    """
    order = np.argsort(most, axis=1)
    enough = np.cumsum(held[order], axis=1) >= k
    kth = np.where(enough.any(1), np.take_along_axis(np.take_along_axis(most, order, 1), enough.argmax(1)[:, None], 1)[:, 0], np.inf)
    return least <= np.minimum(limits, kth)[:, None] + 1e-6


def _nearest_places(gaps: np.ndarray, places: int) -> np.ndarray:
    return np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1) < places


def _route(
    index: VectorIndex, source: DataFrame, k: int, uppers: int | None = None, leaves: int | None = None, chunk: int | None = None
) -> DataFrame:
    """(leaf, slots, query_id, bound, data) for every lower pivot that a query of (query_id, vec, bound, seen) asks.

    Without ``uppers`` and ``leaves`` these are all that may hold a neighbour within ``bound``, but not the pivot
    ``seen``; otherwise the nearest upper pivots and in each of their chunks (or in one) the nearest lower ones.
    """
    dtype = _element(source, "vec")
    query_type = source.schema["query_id"].dataType.simpleString()
    centres, near, far, held = index.centres, index.near, index.far, index.held
    slice_rows = max(1, min(_SLICE_ROWS, _PIVOT_BYTES // (8 * len(centres))))

    def to_uppers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packs = []
            for first in range(0, len(pdf), slice_rows):
                rows = pdf.iloc[first : first + slice_rows]
                raw = _matrix(rows["vec"]).astype(dtype)
                gaps = np.sqrt(_distances(_unit(raw.astype(np.float64)), centres))
                bounds = rows["bound"].to_numpy(dtype=float, na_value=np.inf)
                seen, ids = rows["seen"].to_numpy(dtype=np.int64, na_value=-1), rows["query_id"].to_numpy()
                if uppers is None:
                    least = np.maximum(np.maximum(gaps - far, near - gaps), 0.0)
                    wanted = _within(least, gaps + far, held, np.sqrt(bounds), k) & (held > 0)
                else:
                    wanted = _nearest_places(np.where(held > 0, gaps, np.inf), uppers) & (held > 0)
                for u in np.flatnonzero(wanted.any(0)):
                    at = np.flatnonzero(wanted[:, u])
                    packs.append({"upper": u, "q_ids": ids[at], "bounds": bounds[at], "seen": seen[at], "q_data": raw[at].tobytes()})
            if packs:
                yield pd.DataFrame(packs)

    def asked_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for row in pdf.itertuples():
                raw = np.frombuffer(row.q_data, dtype=dtype).reshape(len(row.q_ids), -1)
                below = np.frombuffer(b"".join(row.vec)).reshape(len(row.leaf), -1)
                gaps = np.sqrt(_distances(_unit(raw.astype(np.float64)), below))
                if leaves is None:
                    least = np.maximum(np.maximum(gaps - row.farthest, np.asarray(row.nearest) - gaps), 0.0)
                    wanted = _within(least, gaps + row.farthest, np.asarray(row.n), np.sqrt(row.bounds), k)
                else:
                    wanted = _nearest_places(gaps, leaves)
                q, at = np.nonzero(wanted & (np.asarray(row.leaf)[None, :] != np.asarray(row.seen)[:, None]))
                data = [r.tobytes() for r in raw]
                yield {
                    "leaf": np.asarray(row.leaf)[at],
                    "slots": np.asarray(row.slots)[at],
                    "query_id": np.asarray(row.q_ids)[q],
                    "bound": np.asarray(row.bounds)[q],
                    "data": [data[i] for i in q],
                }

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _joined(asked_leaves(batches))

    packs = source.mapInPandas(
        to_uppers, f"upper int, q_ids array<{query_type}>, bounds array<double>, seen array<bigint>, q_data binary"
    )
    below = index.leaves if chunk is None else index.leaves.where(F.col("chunk") == chunk)
    met = packs.join(below.drop("low", "high", "chunk"), "upper")
    return met.mapInPandas(to_leaves, f"leaf bigint, slots int, query_id {query_type}, bound double, data binary")


def _packs(rows: DataFrame, key: str, extra: dict[str, str], width: int, dtype: str) -> DataFrame:
    """Query rows of one key together, behind a shuffle that splits hot keys: (key, q_ids, q_data, extra arrays)."""
    size = min(_PACK_ROWS, _rows_per_block(width, dtype))
    query_type = rows.schema["query_id"].dataType.simpleString()

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed(k, part: pd.DataFrame) -> dict:
            data = b"".join(part["data"]) if "data" in part else _matrix(part["vec"]).astype(dtype).tobytes()
            pack = {key: k, "q_ids": part["query_id"].to_numpy(), "q_data": data}
            return pack | {c: part[c].to_numpy() for c in extra}

        yield from _gathered(batches, key, size, max(1, _HELD_BYTES // (width * np.dtype(dtype).itemsize)), closed)

    arrays = "".join(f", {c} array<{kind}>" for c, kind in extra.items())
    schema = f"{key} bigint, q_ids array<{query_type}>, q_data binary{arrays}"
    return rows.hint("rebalance", key).mapInPandas(gather, schema)


def _copies(n_slots: int, tasks: int, n_queries: int, n_vectors: int, vector_bytes: int) -> int:
    """How many times the blocks of an index of ``n_slots`` join keys are copied.

    As often as gives several keys to every task, but not more often than one slot has packs of queries, and no more
    bytes than ``_COPY_BYTES`` or, with many queries, than they have.
    """
    packs = -(-n_queries // _PACK_ROWS)
    room = max(_COPY_BYTES, n_queries * vector_bytes) // max(1, n_vectors * vector_bytes)
    return max(1, min(-(-_KEYS_PER_TASK * tasks // n_slots), packs, room))


def _met(index: VectorIndex, packs: DataFrame, columns: list[str], n_queries: int) -> DataFrame:
    """Packs beside the blocks of their lower pivot.

    Blocks of a hot pivot are split into slots; a pack goes to every slot. Where there are few slots, the packs of a
    slot are split too and its blocks copied (``_copies``), so that there are several times as many join keys as tasks.
    Spark's estimate of the copied side leaves the copies out, so the join is asked to merge: neither side is broadcast.
    """
    spark = packs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    vector_bytes = index.centres.shape[1] * np.dtype(index.dtype).itemsize + (len(index.books) if "codes" in columns else 0)
    splits = _copies(index.n_slots, tasks, n_queries, int(index.held.sum()), vector_bytes)
    blocks = index.blocks.select("leaf", *columns, F.xxhash64("block").alias("lot"))
    if index.n_slots > index.n_leaves:
        known = index.leaves.select(F.explode(F.arrays_zip("leaf", "slots")).alias("z")).select("z.leaf", "z.slots")
        blocks = blocks.join(known, "leaf").withColumn("slot", F.pmod("lot", F.col("slots")).cast("int")).drop("slots")
        packs = packs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.element_at("slots", 1) - 1)))
    else:
        blocks, packs = blocks.withColumn("slot", F.lit(0)), packs.withColumn("slot", F.lit(0))
    packs = packs.withColumn("split", F.pmod(F.xxhash64("q_ids"), F.lit(splits)).cast("int")).drop("slots")
    blocks = blocks.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).drop("lot")
    return packs.join(blocks.hint("merge"), ["leaf", "slot", "split"])


def _arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[SimpleNamespace]:
    """Rows of Arrow batches without a copy: lists as numpy arrays and binaries as buffers, which are the batch's own."""

    def cells(column: pa.Array) -> Callable:
        if pa.types.is_binary(column.type):
            _, ends, data = column.buffers()
            ends = np.frombuffer(ends, np.int32)[column.offset :]
            return lambda i: data.slice(ends[i], ends[i + 1] - ends[i])
        if pa.types.is_list(column.type):
            return lambda i: column[i].values.to_numpy(zero_copy_only=False)
        return lambda i: column[i].as_py()

    for batch in batches:
        read = {c: cells(batch.column(at)) for at, c in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            yield SimpleNamespace(**{c: cell(i) for c, cell in read.items()})


def _compare(index: VectorIndex, rows: DataFrame, k: int, dtype: str, n_queries: int, short: int | None = None) -> DataFrame:
    """The k best in each lower pivot for the query rows of ``_route``: ``query_id, nn_id, distance, leaf``.

    ``short`` reads the codes of a block first and compares its vectors only with the ``short`` best of each query.
    """
    index_dtype, width, books = index.dtype, index.centres.shape[1], index.books
    query_type = rows.schema["query_id"].dataType.simpleString()
    id_type = index.blocks.schema["ids"].dataType.elementType.simpleString()

    def best(row, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_id = np.argsort(row.ids, kind="stable")
        ids = np.asarray(row.ids)[by_id]
        block = _from_bytes(row.data, len(ids), index_dtype)[by_id]
        if short is None or len(ids) <= short:
            return _best_in_block(asked, block, ids, k)
        rough = _decode(row.codes, len(ids), books)[by_id, :width]
        return _best_by_codes(asked, block, rough, ids, k, short)

    def nearest_in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # best neighbours so far of the packs met last: one pack meets the blocks of its slot in a row
        held: dict[tuple, tuple] = {}

        def close(key: tuple) -> pa.RecordBatch:
            q_ids, bounds, gaps, ids = held.pop(key)
            inside = gaps <= bounds[:, None]
            n = inside.sum(1)
            columns = [np.repeat(q_ids, n), ids[inside], gaps[inside], np.full(n.sum(), key[0])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for row in _arrow_rows(batches):
            q_ids = np.array(row.q_ids)  # what is held is copied, else it would keep its batch
            gaps, found = best(row, _from_bytes(row.q_data, len(q_ids), dtype))
            key = (row.leaf, row.slot, q_ids[0])
            if key in held:
                _, bounds, before, before_ids = held.pop(key)
                gaps, found = _merge(np.hstack([before, gaps]), np.hstack([before_ids, found]), k)
            else:
                bounds = np.array(row.bound)
                if len(held) >= _OPEN_PACKS:
                    yield close(next(iter(held)))
            held[key] = (q_ids, bounds, gaps, found)
        for key in list(held):
            yield close(key)

    packs = _packs(rows, "leaf", {"slots": "int", "bound": "double"}, width, dtype)
    pairs = _met(index, packs, ["ids", "data"] if short is None else ["ids", "data", "codes"], n_queries)
    schema = T.StructType.fromDDL(f"query_id {query_type}, nn_id {id_type}, distance double, leaf bigint")
    names, types = schema.names, [f.type for f in to_arrow_schema(schema)]
    return pairs.mapInArrow(nearest_in_pairs, schema)


def _queries(queries: DataFrame, id_col: str, vec: str) -> DataFrame:
    source = queries.select(F.col(id_col).alias("query_id"), F.col(vec).alias("vec")).where("vec is not null")
    return source.select("*", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("bigint").alias("seen"))


def _search(index: VectorIndex, source: DataFrame, k: int) -> DataFrame:
    """The exact k nearest: ``query_id, rank, nn_id, distance``."""
    dtype, n_queries = _element(source, "vec"), source.count()
    sent = max(1, n_queries) * index.centres.shape[1] * np.dtype(dtype).itemsize
    few = max(1, min(_FEW_COPIES, _FEW_SHARE * index.n_leaves), _ROUTED_BYTES / sent)
    if index.n_leaves > few and _asked(index, source, k) > few:
        partial = _scan(index, source, k, dtype, sent)
    elif index.n_leaves <= _ONE_ROUND:
        partial = _compare(index, _route(index, source, k), k, dtype, n_queries)
    else:
        near = _compare(index, _route(index, source, k, uppers=1, leaves=1, chunk=0), k, dtype, n_queries)
        near = settle(top_rows(near, ["query_id"], ["distance", "nn_id"], k).drop("rank"), "near")
        bounds = near.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.max("distance")).alias("bound"), F.first("leaf").alias("seen")
        )
        again = source.select("query_id", "vec").join(bounds, "query_id", "left")
        partial = near.unionByName(_compare(index, _route(index, again, k), k, dtype, n_queries))
    return top_rows(partial, ["query_id"], ["distance", "nn_id"], k).select("query_id", "rank", "nn_id", "distance")


def _asked(index: VectorIndex, source: DataFrame, k: int) -> float:
    """How many lower pivots a query asks on average, by ``_ASKED_SAMPLE`` queries: the first in the order of a hash.

    One pass over the blocks finds their k-th distance. Only how the search goes hangs on this, not what it finds.
    """
    first = source.orderBy(F.xxhash64(F.lit("asked"), "query_id"), "query_id").limit(_ASKED_SAMPLE)
    vectors, index_dtype = [r["vec"] for r in first.select("vec").collect()], index.dtype
    units = _unit(_matrix(vectors).astype(np.float64))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                gaps, _ = _best_in_block(units, _from_bytes(row.data, row.n, index_dtype), np.arange(row.n), k)
                yield pd.DataFrame({"no": np.repeat(np.arange(len(units)), gaps.shape[1]), "gap": gaps.ravel()})

    near = top_rows(index.blocks.select("n", "data").mapInPandas(scan, "no int, gap double"), ["no"], ["gap"], k)
    bounds = near.groupBy("no").agg(F.when(F.count("*") >= k, F.max("gap"))).collect()  # one row for a sampled query
    rows = [(no, vectors[no], bound, None) for no, bound in bounds]
    kind = source.schema["vec"].dataType.simpleString()
    sample = source.sparkSession.createDataFrame(rows, f"query_id int, vec {kind}, bound double, seen bigint")
    return _route(index, sample, k).count() / max(1, len(rows))


def _scan(index: VectorIndex, source: DataFrame, k: int, dtype: str, sent: int) -> DataFrame:
    """``query_id, nn_id, distance`` for queries that few pivots can be ruled out for: all packs beside all blocks.

    Queries are dealt to ``splits`` and blocks to ``parts``, and each pair of a split and a part is one join key. So a
    query is sent ``parts`` times and a block ``splits`` times, whatever the number of pivots: both follow the number of
    cores, and ``splits`` also the queries, as a task holds ``_SCAN_BYTES`` of them. It reads the blocks of its part one
    after the other and keeps the k best of each query.
    """
    spark = source.sparkSession
    width, index_dtype = index.centres.shape[1], index.dtype
    size = min(_SCAN_ROWS, _rows_per_block(width, dtype))
    query_type = source.schema["query_id"].dataType.simpleString()
    id_type = index.blocks.schema["ids"].dataType.elementType.simpleString()
    cells = _CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    # a part costs the queries and k neighbours of each, a split costs the blocks
    splits = max(int(np.ceil((2 * cells) ** 0.5)), -(-sent // _SCAN_BYTES))
    parts = -(-cells // splits)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), size):
                rows = pdf.iloc[first : first + size]
                data = _matrix(rows["vec"]).astype(dtype).tobytes()
                yield pd.DataFrame([{"q_ids": rows["query_id"].to_numpy(), "q_data": data}])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, SimpleNamespace] = {}  # packs of this key with their k best so far
        cell, at, block = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            while held:
                _, pack = held.popitem()
                if "gaps" in vars(pack):
                    known = np.isfinite(pack.gaps)
                    columns = [np.repeat(pack.ids, known.sum(1)), pack.found[known], pack.gaps[known]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for row in _arrow_rows(batches):
            if row.cell != cell:
                yield from close()
                cell = row.cell
            if row.block != at:
                at, block = row.block, _opened(row.ids, row.data, index_dtype)
            if row.pack not in held:
                held[row.pack] = _opened(row.q_ids, row.q_data, dtype)
            _closer(held[row.pack], block, k)
        yield from close()

    def dealt(df: DataFrame, cell: Column) -> DataFrame:
        # many more partitions than keys, so that few keys share one
        return df.withColumn("cell", F.explode(cell)).repartition(8 * splits * parts, "cell")

    packs = source.select("query_id", "vec").mapInPandas(pack, f"q_ids array<{query_type}>, q_data binary")
    packs = packs.withColumn("pack", F.monotonically_increasing_id())
    split, part = F.pmod("pack", F.lit(splits)), F.pmod("block", F.lit(parts))  # in turn in each task that made them
    packs = dealt(packs, F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i * splits + split))
    blocks = index.blocks.select("block", "ids", "data")
    blocks = dealt(blocks, F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda i: part * splits + i))
    schema = T.StructType.fromDDL(f"query_id {query_type}, nn_id {id_type}, distance double")
    names, types = schema.names, [f.type for f in to_arrow_schema(schema)]
    return blocks.join(packs.hint("merge"), "cell").mapInArrow(nearest, schema)


def search(index: VectorIndex, queries: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """The k nearest index vectors of every query: ``query_id, rank, nn_id, distance``.

    Query ids are unique. First each query meets its nearest lower pivot; the k-th distance found there bounds the
    answer. Then it goes only to those other pivots, upper and then lower, that the triangle inequality does not rule
    out, and only neighbours within the bound come back, so the answer is exact and few rows are merged. Equal
    distances go by id. The queries of a lower pivot are packed behind a shuffle, so packs are full where many
    queries ask the same pivot, however many pivots there are.

    Where the inequality rules out too little (a sample tells, ``_asked``), copies of queries for every pivot would grow
    with the square of the table. Then all blocks are read beside a few large groups of queries (``_scan``).
    """
    return _search(index, _queries(queries, id_col, vec), k)


def _best_in_block(vectors: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest block rows (which are in id order) for every vector."""
    gaps, found = [], []
    step = max(1, min(_SLICE_ROWS, _GAP_BYTES // (8 * len(block))))
    for start in range(0, len(vectors), step):
        every = _distances(vectors[start : start + step], block)
        best = _k_smallest(every, k)
        gaps.append(np.take_along_axis(every, best, 1))
        found.append(ids[best])
    return np.concatenate(gaps), np.concatenate(found)


def _opened(ids: np.ndarray, data: bytes, dtype: str) -> SimpleNamespace:
    """Vectors of a block or a pack in double precision, with what ``_closer`` compares them by."""
    units = _from_bytes(data, len(ids), dtype)
    known = np.isfinite(units).all(1)  # a vector with nan is no neighbour and has none
    units, squares = units[known], (units[known] ** 2).sum(1)
    rounded = units.astype(np.float32)
    centre = units.mean(0) if len(units) else np.zeros(units.shape[1])
    gaps = np.sqrt(((units - centre) ** 2).sum(1))
    near, far = (gaps.min(), gaps.max()) if len(units) else (np.inf, np.inf)
    return SimpleNamespace(
        ids=np.array(ids)[known], units=units, squares=squares, rounded=rounded, centre=centre, near=near, far=far
    )


def _closer(pack: SimpleNamespace, block: SimpleNamespace, k: int) -> None:
    """Bring ``gaps`` and ``found``, the k best of each vector of ``pack`` by distance and then id, up to a block.

    Products in single precision, with room for their error, leave out pairs that are beyond the k-th distance so far;
    the distances of the others are taken in double precision and rounded as in ``_distances``.
    """
    if not len(pack.ids) or not len(block.ids):
        return
    if "gaps" not in vars(pack):
        pack.gaps = np.full((len(pack.ids), k), np.inf)
        pack.found = np.full((len(pack.ids), k), block.ids[0], dtype=block.ids.dtype)  # read only where the distance is finite
    room = (block.units.shape[1] + 8) * 2.0**-22
    half = (block.squares / 2).astype(np.float32)
    to_centre = np.sqrt(np.maximum(pack.squares + (block.centre**2).sum() - 2.0 * pack.units @ block.centre, 0.0))
    least = np.maximum(np.maximum(to_centre - block.far, block.near - to_centre), 0.0)
    # beside k vectors at distance 0 only smaller ids matter
    full = (pack.gaps[:, k - 1] == 0) & (pack.found[:, k - 1] < block.ids.min())
    asks = np.flatnonzero((least <= np.sqrt(pack.gaps[:, k - 1]) + 1e-6) & ~full.astype(bool))
    for first in range(0, len(asks), _SLICE_ROWS):
        rows = asks[first : first + _SLICE_ROWS]
        limits, last = pack.gaps[rows, k - 1], pack.found[rows, k - 1]
        products = pack.rounded[rows] @ block.rounded.T
        products -= half
        floor = (pack.squares[rows] - limits - room) / 2
        unknown = np.flatnonzero(np.isinf(floor))
        if len(unknown) and products.shape[1] > k:
            kth = products.shape[1] - k
            floor[unknown] = np.partition(products[unknown], kth, axis=1)[:, kth] - room
        pairs = np.flatnonzero((products >= floor.astype(np.float32)[:, None]).ravel())
        q, at = np.divmod(pairs, products.shape[1])
        sooner = (limits[q] > 0) | (block.ids[at] < last[q]).astype(bool)
        q, at = q[sooner], at[sooner]
        gaps = np.empty(len(q))
        for i in range(0, len(q), _EXACT_PAIRS):
            cut = slice(i, i + _EXACT_PAIRS)
            a, b = rows[q[cut]], at[cut]
            dots = np.einsum("ij,ij->i", pack.units[a], block.units[b])
            gaps[cut] = np.maximum(np.round(pack.squares[a] + block.squares[b] - 2.0 * dots, 12), 0.0)
        inside = gaps <= limits[q]
        q, at, gaps = q[inside], at[inside], gaps[inside]
        better, counts = np.unique(q, return_counts=True)
        if not len(better):
            continue
        # the k best so far and the new ones of each row, in order; the first k of a row stay
        n, better = np.arange(len(better)), rows[better]
        row = np.concatenate([np.repeat(n, k), np.repeat(n, counts)])
        every = np.concatenate([pack.gaps[better].ravel(), gaps])
        ids = np.concatenate([pack.found[better].ravel(), block.ids[at]])
        order = np.lexsort((ids, every, row))
        start = np.cumsum(counts + k) - counts - k
        kept = order[start[:, None] + np.arange(k)]
        pack.gaps[better], pack.found[better] = every[kept], ids[kept]


def _best_by_codes(
    vectors: np.ndarray, block: np.ndarray, rough: np.ndarray, ids: np.ndarray, k: int, short: int
) -> tuple[np.ndarray, np.ndarray]:
    """As ``_best_in_block``, but among the ``short`` block rows whose decoded codes ``rough`` are nearest."""
    step = max(1, min(_SLICE_ROWS, _BLOCK_BYTES // (8 * short * block.shape[1])))
    squares, gaps, found = (block * block).sum(1), [], []
    for start in range(0, len(vectors), _SLICE_ROWS):
        asked = vectors[start : start + _SLICE_ROWS]
        listed = np.sort(_k_smallest(_distances(asked.astype(np.float32), rough), short), axis=1)  # in id order
        for first in range(0, len(asked), step):
            part, at = asked[first : first + step], listed[first : first + step]
            exact = (part * part).sum(1)[:, None] + squares[at] - 2.0 * np.matmul(block[at], part[:, :, None])[:, :, 0]
            exact = np.maximum(np.round(exact, 12), 0.0)
            best = _k_smallest(exact, k)
            gaps.append(np.take_along_axis(exact, best, 1))
            found.append(ids[np.take_along_axis(at, best, 1)])
    return np.concatenate(gaps), np.concatenate(found)


def _merge(gaps: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of two lists side by side, by distance and then id."""
    order = np.argsort(ids, axis=1, kind="stable")
    gaps, ids = np.take_along_axis(gaps, order, 1), np.take_along_axis(ids, order, 1)
    best = _k_smallest(gaps, k)
    return np.take_along_axis(gaps, best, 1), np.take_along_axis(ids, best, 1)


def knn_exact(
    queries: DataFrame, index: DataFrame, k: int, query_id: str = "vec_id", index_id: str = "vec_id",
    vec: str = "embedding", pivots: int | None = None,
) -> DataFrame:
    """k nearest index vectors by squared distance of unit vectors (= 2 - 2 cos), ascending."""
    return search(build_index(index, index_id, vec, pivots), queries, query_id, vec, k)


def measure_probes(
    index: VectorIndex, source: DataFrame, k: int = 10, recall: float = 0.95, sample: int = 256
) -> tuple[int, int]:
    """How many upper pivots, and lower ones below each, hold the share ``recall`` of the k neighbours of indexed vectors.

    At most ``sample`` vectors of ``source`` (id, vec), first rows in the order of a hash, are compared with all blocks in
    one pass, and each neighbour counts by the places of its upper and lower pivot by distance from the query. Of the
    pairs of numbers that reach the share, the one with the fewest lower pivots is taken.
    """
    chosen = source.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample).toPandas()
    ids, asked = chosen["id"].to_numpy(), _unit(_matrix(chosen["vec"]).astype(np.float64))
    index_dtype = index.dtype

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                held = np.asarray(row.ids)
                gaps, found = _best_in_block(asked, _from_bytes(row.data, row.n, index_dtype), held, k + 1)
                no = np.repeat(np.arange(len(asked)), gaps.shape[1])
                other = ids[no] != found.ravel()
                yield pd.DataFrame({"no": no, "leaf": row.leaf, "gap": gaps.ravel()})[other]

    near = index.blocks.select("leaf", "n", "ids", "data").mapInPandas(scan, "no int, leaf bigint, gap double")
    pairs = top_rows(near, ["no"], ["gap", "leaf"], k).select("no", "leaf").toPandas()  # sample x k at most
    if pairs.empty:
        return 1, 1
    wanted = pairs.groupby("leaf")["no"].apply(np.array).to_dict()
    upper_gaps = np.where(index.held > 0, _distances(asked, index.centres), np.inf)
    upper_places = np.argsort(np.argsort(upper_gaps, axis=1, kind="stable"), axis=1)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                if hit := [(i, leaf) for i, leaf in enumerate(row.leaf) if leaf in wanted]:
                    gaps = _distances(asked, np.frombuffer(b"".join(row.vec)).reshape(len(row.leaf), -1))
                    rank = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1)
                    for i, leaf in hit:
                        no = wanted[leaf]
                        yield pd.DataFrame({"upper_place": upper_places[no, row.upper], "leaf_place": rank[no, i]})

    met = index.leaves.select("upper", "leaf", "vec").mapInPandas(places, "upper_place int, leaf_place int").toPandas()
    upper, leaf = met["upper_place"].to_numpy(), met["leaf_place"].to_numpy()
    needed = int(np.ceil(recall * len(met)))
    options = []
    for u in np.unique(upper):
        below = np.sort(leaf[upper <= u])
        if len(below) >= needed:
            options.append((int(u) + 1, int(below[needed - 1]) + 1))
    return min(options, key=lambda o: (o[0] * o[1], o))


def search_codes(
    index: VectorIndex, queries: DataFrame, id_col: str, vec: str, k: int,
    probes: tuple[int, int] | None = None, short: int | None = None,
) -> DataFrame:
    """About the k nearest index vectors of every query: ``query_id, rank, nn_id, distance``, distances exact.

    Every query goes to ``probes`` pivots (those kept with the index). In each of their blocks the codes are read first:
    look-ups in the code books give the vectors back roughly. The ``short`` best (20 k) of a block are compared exactly
    in the same place, so at most k rows of a query leave a pivot, and its vector travels once to each pivot.
    """
    if index.books is None:
        raise ValueError("build the index with codes=True")
    short, probes = max(k, short or 20 * k), probes or index.probes
    source = _queries(queries, id_col, vec)
    near = _compare(index, _route(index, source, k, *probes), k, _element(source, "vec"), source.count(), short)
    return top_rows(near, ["query_id"], ["distance", "nn_id"], k).select("query_id", "rank", "nn_id", "distance")


def knn_approx(
    queries: DataFrame, index: DataFrame, k: int, probes: tuple[int, int] | None = None, query_id: str = "vec_id",
    index_id: str = "vec_id", vec: str = "embedding", pivots: int | None = None, recall: float = 0.95,
    short: int | None = None,
) -> DataFrame:
    """As ``knn_exact``, but by codes in as many cells as ``recall`` takes on a sample of the index, then re-ranked."""
    built = build_index(index, index_id, vec, pivots, codes=True, k=k, recall=recall)
    return search_codes(built, queries, query_id, vec, k, probes, short)


def neighbour_arrays(neighbours: DataFrame, keep: DataFrame, on: str = "query_id") -> DataFrame:
    """Neighbour rows -> ``distances`` and ``nn_ids`` arrays in rank order beside the query columns."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "distance", "nn_id")))
    lists = neighbours.groupBy(on).agg(ordered.alias("_nn"))
    return keep.join(lists, on).select(
        *keep.columns,
        F.transform("_nn", lambda e: e["distance"]).alias("distances"),
        F.transform("_nn", lambda e: e["nn_id"]).alias("nn_ids"),
    )


def slice_neighbours(df: DataFrame, k: int) -> DataFrame:
    """First k entries of the neighbour arrays."""
    return df.withColumns({c: F.slice(c, 1, k) for c in ("nn_ids", "distances")})


def zip_explode_neighbours(df: DataFrame, keep: list[str]) -> DataFrame:
    """Parallel arrays -> rows ``keep..., rank, nn_id, distance``."""
    pairs = F.arrays_zip(F.col("nn_ids"), F.col("distances"))
    return df.select(*keep, F.posexplode(pairs).alias("_pos", "_nn")).select(
        *keep, (F.col("_pos") + 1).alias("rank"), F.col("_nn.nn_ids").alias("nn_id"),
        F.col("_nn.distances").alias("distance"),
    )


# ---------------------------------------------------------------------------------------------------
# Full distance tables (rows x centroids)


def distance_table(
    df: DataFrame, centroids: DataFrame, id_col: str, vec: str, centroid_id: str, centroid_vec: str,
    score: str = "cosine", top: int | None = None, limit_bytes: int = 8 << 20,
) -> DataFrame:
    """Every row against every centroid: ``<id_col>, <centroid_id>, score``.

    ``score``: ``cosine`` or ``euclidean`` (of unit vectors), or ``cosine_softmax`` and
    ``inv_sq_distance``, which sum to 1 over all centroids of a row (a distance of 0 takes the whole).
    ``top`` keeps the k nearest centroids of a row, the smaller id first on ties. Rows without a vector are left out.

    Rows travel in packs and centroids in blocks of about ``limit_bytes``; every pack meets every block in a
    join, which Spark broadcasts or shuffles by the size of the blocks. Neither passes through the driver.
    """
    normalised = score in ("cosine_softmax", "inv_sq_distance")
    table = settle(
        centroids.select(F.col(centroid_id).alias("id"), doubles(F.col(centroid_vec)).alias("vec")), "centroids"
    )
    size = table.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not size["n"]:
        raise ValueError("no centroids")
    spark = df.sparkSession
    parts = -(-size["n"] * size["width"] * 8 // limit_bytes)
    splits = max(1, -(-_KEYS_PER_TASK * spark.sparkContext.defaultParallelism // parts))
    source = df.select(F.col(id_col).alias("row"), F.col(vec).alias("vec")).where("vec is not null")
    row_type = source.schema["row"].dataType.simpleString()
    id_type = table.schema["id"].dataType.simpleString()
    dtype = _element(df, vec)
    pack_rows = min(_PACK_ROWS, _rows_per_block(size["width"], dtype))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), pack_rows):
                rows = pdf.iloc[start : start + pack_rows]
                data = _matrix(rows["vec"]).astype(dtype).tobytes()
                split = zlib.crc32(str(rows["row"].iat[0]).encode()) % splits
                yield pd.DataFrame([{"split": split, "rows": rows["row"].to_numpy(), "data": data}])

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    packs = source.mapInPandas(pack, f"split int, rows array<{row_type}>, data binary").withColumn("part", every(parts))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    blocks = table.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("c"))  # limit_bytes each
    blocks = blocks.select("part", F.col("c.id").alias("ids"), F.flatten("c.vec").alias("flat"), every(splits).alias("split"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pair in pdf.itertuples():
                ids, rows = np.asarray(pair.ids), np.asarray(pair.rows)
                centres = _unit(np.asarray(pair.flat, dtype=np.float64).reshape(len(ids), -1))
                vectors = _from_bytes(pair.data, len(rows), dtype)
                step = max(1, (16 << 20) // (8 * len(ids)))
                for start in range(0, len(rows), step):
                    cut = slice(start, start + step)
                    yield scored(pair.part, rows[cut], vectors[cut], ids, centres)

    def scored(part: int, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, centres: np.ndarray) -> pd.DataFrame:
        cosine = vectors @ centres.T
        hits = np.zeros(len(rows))
        if score in ("cosine", "cosine_softmax"):
            weight = np.exp(cosine) if normalised else cosine
        else:
            squares = _distances(vectors, centres)
            weight = np.sqrt(squares)
            if normalised:
                hits = (squares == 0).sum(1).astype(float)
                weight = np.where(squares == 0, np.inf, 1.0 / np.where(squares == 0, 1.0, squares))
        total = np.where(np.isfinite(weight), weight, 0.0).sum(1)
        if top is not None and top < weight.shape[1]:
            rank = weight if score == "euclidean" else -weight
            kept = _k_smallest(rank, top)
        else:
            kept = np.broadcast_to(np.arange(weight.shape[1]), weight.shape)
        n = kept.shape[1]
        return pd.DataFrame(
            {
                "row": np.repeat(rows, n),
                "id": ids[kept.ravel()],
                "weight": np.take_along_axis(weight, kept, 1).ravel(),
                "total": np.repeat(total, n),
                "hits": np.repeat(hits, n),
                "part": part,
            }
        )

    schema = f"row {row_type}, id {id_type}, weight double, total double, hits double, part int"
    rows = packs.join(blocks, ["part", "split"]).mapInPandas(compare, schema)
    if normalised and parts > 1:
        sums = (
            rows.groupBy("row", "part").agg(F.max("total").alias("total"), F.max("hits").alias("hits"))
            .groupBy("row").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))
        )
        rows = rows.drop("total", "hits").join(sums, "row")
    if top is not None and parts > 1:
        best = F.col("weight") if score == "euclidean" else F.desc("weight")
        rows = top_rows(rows, ["row"], [best, "id"], top)
    value = F.col("weight")
    if normalised:
        exact = F.when(value == F.lit(float("inf")), 1.0 / F.col("hits")).otherwise(0.0)
        value = F.when(F.col("hits") > 0, exact).otherwise(value / F.col("total"))
    out = rows.select(F.col("row").alias(id_col), F.col("id").alias(centroid_id), value.alias("score"))
    return out
