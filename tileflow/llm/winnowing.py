"""Document fingerprints by winnowing.

The hash of every ``gram`` neighbouring characters comes from running sums (a rolling polynomial). Of every
``window`` neighbouring hashes the smallest is chosen, of equal ones the rightmost, and its position is kept. Two
texts that share a passage of at least ``gram + window - 1`` characters share a chosen hash of it; passages shorter
than ``gram`` are never matched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tileflow.llm.folders import stored
from tileflow.llm.words import U64, mix, parts, powers, sliding_argmin

_BASE = 0xA24BAED4963EE407
_BLOCK = 1 << 18


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` neighbouring code points."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    up, down = _powers(min(n, _BLOCK) + gram)
    with np.errstate(over="ignore"):
        for lo in range(0, n, _BLOCK):
            hi = min(lo + _BLOCK, n)
            part = codes[lo : hi + gram - 1].astype(U64) + U64(1)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            out[lo:hi] = mix((total[gram:] - total[:-gram]) * down[: hi - lo])
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << (n - 1).bit_length()
    if size not in _tables:
        _tables[size] = powers(_BASE, size), powers(pow(_BASE, -1, 2**64), size)
    return _tables[size]


def fingerprint(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that winnowing chooses, in order of position.

    A text shorter than ``gram`` is one gram, one with fewer than ``window`` grams is one window; an empty text has
    none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    hashes = gram_hashes(codes, min(gram, len(codes)))
    chosen = sliding_argmin(hashes, min(window, len(hashes)))
    at = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    return at, hashes[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty sets."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def written(at: np.ndarray, hashes: np.ndarray) -> str:
    """Hexadecimal position (12 digits) and hash (16 digits) of each chosen gram, one space apart."""
    if not len(at):
        return ""
    rows = np.empty(len(at), np.dtype([("at", ">u8"), ("hash", ">u8")]))
    rows["at"], rows["hash"] = at, hashes
    return np.delete(rows.view(np.uint8).reshape(-1, 16), (0, 1), axis=1).tobytes().hex(" ", 14)


def _fingerprints(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            made = [fingerprint(t or "", gram, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([a for a, _ in made], pa.list_(pa.int64())),
                    pa.array([h.view(np.int64) for _, h in made], pa.list_(pa.int64())),
                ],
                names=["row", "positions", "hashes"],
            )

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", gram: int = 16, window: int = 24) -> DataFrame:
    """``docs`` with positions and hashes (arrays of long) of its texts added.

    Defined cases: a null or empty text has empty arrays; columns called like an added one are replaced, all other
    columns pass through; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("positions", "hashes")]).alias("row"), F.col(text_col).alias("text"))
    out = StructType([rows.schema["row"]]).add("positions", ArrayType(LongType())).add("hashes", ArrayType(LongType()))
    return rows.mapInArrow(_fingerprints(gram, window), out).select("row.*", "positions", "hashes")


def _edited(gram: int, window: int):
    """Rows part, own, id, text in order of the part, then the document; a part's last row may be another part's first."""
    names = ["row", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in parts(batches, "text"):
            own, part, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2)
            for i, text in enumerate(batch.column(3).to_pylist()):
                text = text or ""
                yield part[i], own[i], ids.slice(i, 1), text, fingerprint(text, gram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        held, before = 0, None
        for now in rows(batches):
            if before is not None and before[0] == now[0]:
                _, _, row, text, mine = before
                n = len(text)
                changed = text[: n - n // 4] + now[3][: n // 4]
                other = fingerprint(changed, gram, window)
                digest = sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                values = row, n, digest, written(*mine), written(*other), likeness(mine[1], other[1]), likeness(mine[1], now[4][1])
                for column, value in zip(out, values):
                    column.append(value)
                held += n
                if held > 1 << 20:
                    yield batch_of(out)
                    out, held = [[] for _ in names], 0
            before = now if now[1] else None
        if out[0]:
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        rest = [pa.array(v, t) for v, t in zip(out[1:], types)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(out[0]), *rest], names=names)

    return run


def edit_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = 16,
    window: int = 24,
    part_rows: int = 1000,
    most_parts: int = 20_000,
) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last quarter comes from the next document.

    id, n_chars (long), edited_sha256, fingerprint, edited_fingerprint (``written``), near_edited, near_next
    (double). The next document has the next larger id; after the last comes the first. Documents are cut into
    ranges of about ``part_rows`` ids; the first document of a range goes to the range before as well, so each
    range is worked on alone. Fingerprints hold positions and hashes; likeness is that of the sets of hashes.
    Defined cases: a null text is the empty text; likeness of two empty texts is 1; a null id stands before all
    others; rows with equal ids follow each other by text; a single document is its own next one; other columns
    are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    cuts = max(1, min(most_parts, n // part_rows))
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    found = rows.agg(F.percentile_approx("id", shares, 10 * cuts)).first()[0] if cuts > 1 else None
    edges = np.array(sorted(set(found or [])))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, ids.fillna(edges[0]).to_numpy(), side="right")
        return pd.Series(np.where(ids.isna(), 0, at))

    parted = rows.select((part_of("id") if len(edges) else F.lit(0)).alias("part"), F.lit(True).alias("own"), "id", "text")
    firsts = parted.groupBy("part").agg(F.min(F.struct("id", "text")).alias("first"))
    firsts = stored(firsts, "firsts")
    order = [r["part"] for r in firsts.select("part").orderBy("part").collect()]  # at most ``most_parts`` numbers
    before = docs.sparkSession.createDataFrame(list(zip(order, [*order[-1:], *order[:-1]])), "part int, to int")
    guests = firsts.join(before, "part").select(F.col("to").alias("part"), F.lit(False).alias("own"), "first.*")
    dealt = parted.unionByName(guests).repartition("part").sortWithinPartitions("part", F.desc("own"), "id", "text")
    dealt = dealt.select("part", "own", F.struct("id").alias("row"), "text")
    out = StructType([dealt.schema["row"]]).add("n_chars", "long")
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        out = out.add(name, "string")
    made = dealt.mapInArrow(_edited(gram, window), out.add("near_edited", "double").add("near_next", "double"))
    return made.select(F.col("row.id").alias(id_col), *out.names[1:])
