"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``. No string object is made per word; hashes are 64-bit polynomials of the bytes,
finished by a mixer. Work goes in blocks of about a megabyte, so memory follows the largest single text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base & (2**64 - 1), U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


class Texts:
    """The texts of an Arrow string array: ``data`` holds their bytes, text i is data[ends[i]:ends[i + 1]]."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[ends[0] : ends[-1]]
        self.ends = ends - ends[0]

    def __len__(self) -> int:
        return len(self.ends) - 1


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of about ``limit`` bytes of text or of one row."""
    at = None
    for batch in batches:
        at = batch.schema.get_field_index(column) if at is None else at
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


class Words:
    """Words of texts: ``start`` and ``end`` byte positions, and ``first``: the words of text i are first[i]:first[i + 1]."""

    def __init__(self, texts: Texts, lower: bool = False):
        self.texts = texts
        self.data = LOWER[texts.data] if lower else texts.data
        solid = np.zeros(len(self.data) + 2, bool)
        solid[1:-1] = ~SPACE[self.data]
        inner = solid[1:-1]
        begins = inner & ~solid[:-2]
        ends = inner & ~solid[2:]
        edges = texts.ends[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        begins[edges] = inner[edges]
        ends[edges - 1] = inner[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, texts.ends)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self), U64)
        lo = 0
        with np.errstate(over="ignore"):
            pw = inverse = np.zeros(0, U64)
            while lo < len(self):
                a = self.start[lo]
                hi = max(int(np.searchsorted(self.end, a + _BLOCK)), lo + 1)
                b = self.end[hi - 1]
                if len(pw) < b - a:
                    pw, inverse = powers(_BASE, b - a), powers(pow(_BASE, -1, 2**64), b - a)
                total = np.zeros(b - a + 1, U64)
                np.cumsum((self.data[a:b].astype(U64) + U64(1)) * pw[: b - a], out=total[1:])
                s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
                out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
                lo = hi
        return out


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """An order-aware hash of every ``size`` neighbouring hashes (windows across texts included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, size + 1, dtype=U64) + U64(salt * 1000)) | U64(1)
        out = np.zeros(n, U64)
        for j in range(size):
            out += hashes[j : j + n] * factors[j]
        return mix(out)


def fold(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of values[cuts[i]:cuts[i + 1]]."""
    total = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[cuts[1:]] - total[cuts[:-1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then those of starts[1], ..."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


def sliding_argmin(values: np.ndarray, width: int, block: int = 1 << 20) -> np.ndarray:
    """Position of the smallest value of every ``width`` neighbours, of equal ones the rightmost.

    The upper 42 bits of the values are compared.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    low = U64((1 << 22) - 1)
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        part = values[lo : hi + width - 1]
        least = (part & ~low) | (low - np.arange(len(part), dtype=U64))
        span = 1  # least[i] is the minimum of span neighbours from i
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        out[lo:hi] = (low - (least & low)).astype(np.int64) + lo
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
