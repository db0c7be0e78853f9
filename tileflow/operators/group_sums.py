"""Sums of vectors per group as matrix blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StructField, StructType, VariantType

HELD = 64 << 20  # bytes of sums that a task holds
_NAN = float("nan")  # one object, so that nan keys are one entry of a dictionary


def plain_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the keys can be entries of a dictionary."""
    nested = (ArrayType, MapType, StructType, VariantType)
    return bool(keys) and not any(isinstance(df.schema[k].dataType, nested) for k in keys)


class _Sums:
    """Sums and counts of the groups seen, a row of a matrix each."""

    def __init__(self, width: int):
        self.place: dict[tuple, int] = {}
        self.sums = np.zeros((16, width))
        self.n = np.zeros(16, np.int64)

    def add(self, keys: list[tuple], n: np.ndarray, values: np.ndarray) -> None:
        at = np.array([self.place.setdefault(k, len(self.place)) for k in keys])
        while len(self.place) > len(self.n):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        order = np.argsort(at, kind="stable")
        groups, first = np.unique(at[order], return_index=True)
        self.sums[groups] += np.add.reduceat(values[order], first, axis=0)
        self.n[groups] += np.add.reduceat(n[order], first)

    def rows(self, names: Sequence[str], types: Sequence[pa.DataType], rest: list[tuple]) -> pa.RecordBatch:
        """The groups as rows; those of ``rest`` have no vectors."""
        columns = list(zip(*self.place, *rest))
        flat = self.sums[: len(self.place)].reshape(-1)
        cuts = np.concatenate([np.arange(len(self.place) + 1) * self.sums.shape[1], np.full(len(rest), len(flat))])
        n = np.concatenate([self.n[: len(self.place)], np.zeros(len(rest), np.int64)])
        sums = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(n), sums], names=[*names, "n", "total"])


def _add_up(n_keys: int, ordered: bool, held: int):
    """Rows keys, n, total: summed per group; ``ordered`` rows of a group follow each other and become one row.

    Otherwise sums leave when they fill ``held`` bytes, so a group may give several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, empty, names, types, last = None, {}, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, types = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            columns = [batch.column(i).to_pylist() for i in range(n_keys)]
            keys = [tuple(_NAN if k != k else k for k in row) for row in zip(*columns)]
            n, vectors = batch.column(n_keys).to_numpy(), batch.column(n_keys + 1)
            counted = np.flatnonzero(n)
            empty.update((keys[i], None) for i in np.flatnonzero(n == 0))
            if len(counted):
                vectors = vectors.take(pa.array(counted))
                values = vectors.flatten()
                width = len(values) // len(counted)
                lengths = np.diff(vectors.offsets.to_numpy())
                if values.null_count or (lengths != (made.sums.shape[1] if made else width)).any():
                    raise ValueError("vectors must have one length and no null entries")
                made = made or _Sums(width)
                made.add([keys[i] for i in counted], n[counted], values.to_numpy().reshape(len(counted), width))
            last = keys[-1]
            if (made and made.sums[: len(made.place)].nbytes > held) or len(empty) > 100_000:
                kept = None
                if ordered and made and last in made.place:  # its rows may go on in the next batch
                    i = made.place[last]
                    kept = made.sums[i : i + 1].copy(), made.n[i : i + 1].copy()
                    if i != len(made.place) - 1:
                        raise ValueError("rows are not in the order of their groups")
                    del made.place[last]
                seen = made.place if made else {}
                wait = {last: None} if ordered and last in empty else {}
                rest = [k for k in empty if k not in seen and k not in wait and not (kept and k == last)]
                made_width = made.sums.shape[1] if made else 0
                if seen or rest:
                    yield (made or _Sums(0)).rows(names, types, rest)
                made, empty = _Sums(made_width) if made else None, wait
                if kept:
                    made.add([last], kept[1], kept[0])
        seen = made.place if made else {}
        rest = [k for k in empty if k not in seen]
        if seen or rest:
            yield (made or _Sums(0)).rows(names, types, rest)

    return run


def sums_by_group(df: DataFrame, keys: Sequence[str], vec: Column, held: int = HELD) -> DataFrame:
    """``keys, n, total`` (array of double): number and sum of the vectors of each group.

    Every task adds its vectors up in a matrix, a row for each group, and sends a row for each group; behind the
    shuffle the rows of a group meet in order and are added up again. So a hot group costs a row for each task, or for
    each time the sums of a task fill ``held`` bytes, and tasks hold ``held`` bytes and a batch.
    A null key is a group, null vectors do not count, and a group of null vectors only has n = 0 and an empty total.
    Vectors must have one length and no null entries.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        vec.isNotNull().cast("bigint").alias("n"),
        F.coalesce(vec.cast("array<double>"), F.array().cast("array<double>")).alias("total"),
    )
    fields = [StructField(n, df.schema[k].dataType) for k, n in zip(keys, names)]
    schema = StructType([*fields, StructField("n", LongType()), StructField("total", ArrayType(DoubleType()))])
    sent = rows.mapInArrow(_add_up(len(keys), False, held), schema)
    dealt = sent.repartition(*names).sortWithinPartitions(*names)
    out = dealt.mapInArrow(_add_up(len(keys), True, held), schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", "total")
