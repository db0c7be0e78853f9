"""Tiling, masks and morphology over image rows.

An image row is ``image_name, height, width, channels, data`` with row-major bytes; a mask is one binary
column: a zlib-compressed ``.npy`` array of zeros and ones. One row is handled at a time inside Arrow
batches, so the work spreads with the rows, and mask bytes are shuffled only where masks of several rows
are merged (``mask_or``).
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileflow.operators.shaping import unpivot_by_name

# The classes that masks are made for, and those that are merged as vegetation.
MASK_CLASSES = ("leaf", "flower", "plant", "sand", "wood", "tape", "tree", "rock", "vegetation")
POSITIVE_MASKS = ("plant_mask", "flower_mask", "leaf_mask")


_OUT_BYTES = 8 << 20  # bytes that rows made in Python take before they go back to Spark
_OUT_ROWS = 4096
_ARROW = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

# -------------------------------------------------------------------------------- array helpers


def encode_mask(mask: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(mask, dtype=np.uint8))
    return zlib.compress(out.getvalue())


def decode_mask(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(zlib.decompress(data)))


def exploded(
    df: DataFrame, used: Sequence[str], made: str, make: Callable[..., Iterable[tuple]], along: str | None = None
) -> DataFrame:
    """The rows that ``make`` gives for the ``used`` columns of a row, beside the row's other columns.

    ``made`` names the new columns (``tile int, data binary``). Of an array column ``along`` every made row gets its own
    element. Rows are read one at a time and go back to Spark in bounded batches, so Python's memory does not depend on
    how many rows a task has or a row becomes.
    """
    rest = [c for c in df.columns if c not in used and c != along]
    fields = [f.strip().split(" ") for f in made.split(",")]
    own = [T.StructField(along, df.schema[along].dataType.elementType)] if along else []
    kept = [*own, *df.select(*rest).schema.fields]
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    names = schema.names

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            source = [batch.column(batch.schema.get_field_index(c)) for c in used]
            elements, first = None, np.zeros(batch.num_rows, np.int64)
            if along:
                arrays = batch.column(batch.schema.get_field_index(along))
                elements = arrays.flatten()
                lengths = np.asarray(arrays.value_lengths().fill_null(0), np.int64)
                first = np.cumsum(lengths) - lengths
            held: list[tuple] = []
            at: list[int] = []
            place: list[int] = []
            size = 0

            def close() -> pa.RecordBatch:
                columns = [] if elements is None else [elements.take(pa.array(place, pa.int64()))]
                columns += [o.take(pa.array(at, pa.int64())) for o in others]
                columns += [pa.array([row[i] for row in held], _ARROW[t]) for i, (_, t) in enumerate(fields)]
                return pa.RecordBatch.from_arrays(columns, names)

            for i in range(batch.num_rows):
                for j, row in enumerate(make(*[c[i].as_py() for c in source])):
                    held.append(row)
                    at.append(i)
                    place.append(int(first[i]) + j)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size >= _OUT_BYTES or len(held) >= _OUT_ROWS:
                        yield close()
                        held, at, place, size = [], [], [], 0
            if held:
                yield close()

    return df.select(*([along] if along else []), *rest, *used).mapInArrow(spread, schema)


def _image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def _tiles(array: np.ndarray, n: int, order: str) -> Iterator[tuple[int, np.ndarray]]:
    """n x n equal tiles; what is left over at the right and bottom edge is dropped."""
    h, w = array.shape[0] // n, array.shape[1] // n
    for i in range(n * n):
        row, col = (i % n, i // n) if order == "columns" else (i // n, i % n)
        yield i, array[row * h : (row + 1) * h, col * w : (col + 1) * w]


def _distance(mask: np.ndarray) -> np.ndarray:
    """City-block distance to the nearest set pixel: along the columns first, then along the rows."""
    h, w = mask.shape
    far = np.int32(2**28)
    y, x = np.arange(h, dtype=np.int32)[:, None], np.arange(w, dtype=np.int32)
    above = y - np.maximum.accumulate(np.where(mask, y, -far), axis=0)
    below = np.minimum.accumulate(np.where(mask, y, far)[::-1], axis=0)[::-1] - y
    near = np.minimum(above, below)
    left = np.minimum.accumulate(near - x, axis=1) + x
    right = np.minimum.accumulate((near + x)[:, ::-1], axis=1)[:, ::-1] - x
    return np.minimum(left, right)


def _dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Grow by a diamond; outside the image counts as background."""
    return _distance(mask) <= radius


def _erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Shrink by a diamond; outside the image counts as foreground."""
    return ~_dilate(~mask, radius)


def _known(measure: Callable) -> Callable:
    """The measure of a mask, null for a null mask; one mask is decoded at a time."""
    return lambda data: None if data is None else measure(decode_mask(data))


def _components(mask: np.ndarray) -> int:
    """Number of 8-connected regions: horizontal runs are joined where they touch in the next row."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    edges = np.diff(padded, axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]  # one past the end
    n = len(row)
    if n == 0:
        return 0
    width = mask.shape[1] + 2
    # runs of the next row that touch [first - 1, last] form one range in the sorted run list
    low = np.searchsorted(row * width + last, (row + 1) * width + first, "left")
    high = np.searchsorted(row * width + first, (row + 1) * width + last, "right")
    counts = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), counts)
    b = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return len(np.unique(label))
        label = new


# ---------------------------------------------------------------------------------------- tiles


def tile_image(images: DataFrame, n: int, order: str = "columns") -> DataFrame:
    """n x n tiles of every image: ``image_name, tile, height, width, channels, data`` per tile.

    ``order``: tiles are numbered down the columns (``columns``) or along the rows (``rows``).
    """

    def cut(*image) -> Iterator[tuple]:
        return ((i, *t.shape, t.tobytes()) for i, t in _tiles(_image(*image), n, order))

    used = ("height", "width", "channels", "data")
    return exploded(images, used, "tile int, height int, width int, channels int, data binary", cut)


def tile_mask(masks: DataFrame, n: int, mask: str = "mask", order: str = "columns") -> DataFrame:
    """n x n tiles of every mask: the other columns, ``tile`` and the tile's mask."""

    def cut(data: bytes | None) -> Iterator[tuple]:
        return ((i, encode_mask(t)) for i, t in (() if data is None else _tiles(decode_mask(data), n, order)))

    return exploded(masks, [mask], f"tile int, {mask} binary", cut)


def tile_coverage(masks: DataFrame, n: int, mask: str = "mask", order: str = "columns") -> DataFrame:
    """Share of covered pixels per tile: the other columns, ``tile, pct_covered``. A null mask has no tiles."""

    @F.pandas_udf("array<double>")
    def cover(data: pd.Series) -> pd.Series:
        return data.map(_known(lambda m: [float(t.mean()) for _, t in _tiles(m, n, order)]))

    rest = [c for c in masks.columns if c != mask]
    return masks.select(*rest, F.posexplode(cover(F.col(mask))).alias("tile", "pct_covered"))


def tile_coverage_grids(
    masks: DataFrame, sizes: Sequence[int], mask: str = "mask", order: str = "columns"
) -> DataFrame:
    """``tile_coverage`` of several grid sizes from one read of the mask: the other columns, ``n, tile, pct_covered``."""

    @F.pandas_udf("array<struct<n:int, tile:int, pct_covered:double>>")
    def cover(data: pd.Series) -> pd.Series:
        def shares(array: np.ndarray) -> list[tuple]:
            return [(n, i, float(t.mean())) for n in sizes for i, t in _tiles(array, n, order)]

        return data.map(_known(shares))

    rest = [c for c in masks.columns if c != mask]
    return masks.select(*rest, F.inline(cover(F.col(mask))))


def covered_tile_count(
    masks: DataFrame, sizes: Sequence[int] = range(3, 11), threshold: float = 0.5, mask: str = "mask"
) -> DataFrame:
    """Tiles covered by more than ``threshold``, for every grid size, from one read of the mask."""

    @F.pandas_udf("array<struct<n:int, covered_tiles:int>>")
    def count(data: pd.Series) -> pd.Series:
        def per_size(array: np.ndarray) -> list[tuple[int, int]]:
            return [(n, sum(t.mean() > threshold for _, t in _tiles(array, n, "rows"))) for n in sizes]

        return data.map(_known(per_size))

    rest = [c for c in masks.columns if c != mask]
    return masks.select(*rest, F.inline(count(F.col(mask))))


def mask_stats(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """``total`` and ``covered`` pixels per mask, and their ratio ``mean``."""

    @F.pandas_udf("struct<total:bigint, covered:bigint>")
    def stats(data: pd.Series) -> pd.DataFrame:
        found = [_known(lambda a: (a.size, int(a.sum())))(m) or (None, None) for m in data]
        return pd.DataFrame(found, columns=["total", "covered"], dtype="Int64")

    rest = [c for c in masks.columns if c != mask]
    out = masks.select(*rest, stats(F.col(mask)).alias("_s")).select(*rest, "_s.*")
    return out.withColumn("mean", F.try_divide("covered", "total"))


# ------------------------------------------------------------------------------- merging masks


def merge_masks(wide: DataFrame, types: Sequence[str] = POSITIVE_MASKS, out: str = "mask") -> DataFrame:
    """OR of several mask columns of the same row; nulls are skipped. Nothing is shuffled."""

    @F.pandas_udf("binary")
    def union(data: pd.DataFrame) -> pd.Series:
        def one(row) -> bytes | None:
            arrays = [decode_mask(m) for m in row if m is not None]
            return encode_mask(np.bitwise_or.reduce(arrays)) if arrays else None

        return pd.Series([one(row) for row in data.itertuples(index=False)], dtype=object)

    return wide.withColumn(out, union(F.struct(*types)))


def mask_or(df: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    """OR of all masks of a group.

    Every task first sorts and merges the masks it has, so a group of any size reaches the shuffle as a few masks
    per task; behind the shuffle the sorted rows stream through likewise. One group is open at a time.
    """
    names = list(keys)
    rows = df.select(*names, F.col(mask).alias("mask")).where("mask is not null")
    # A null key is a group of its own, as in SQL; pandas would confuse it with nan.
    ids = F.struct(*names)
    rows = rows.select(F.to_json(ids, {"ignoreNullFields": "false"}).alias("_group"), *names, "mask")
    schema = rows.schema

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, array = None, None

        def close() -> pd.DataFrame:
            return pd.DataFrame([(*head, encode_mask(array))], columns=["_group", *names, "mask"])

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                mask = decode_mask(row[-1])
                if head is not None and row[0] == head[0]:
                    array |= mask
                    continue
                if head is not None:
                    yield close()
                head, array = row[:-1], mask
        if head is not None:
            yield close()

    partial = rows.sortWithinPartitions("_group").mapInPandas(merge, schema)
    merged = partial.repartition("_group").sortWithinPartitions("_group").mapInPandas(merge, schema)
    return merged.select(*names, F.col("mask").alias(mask))


def class_mask_merge(
    instances: DataFrame, keys: Sequence[str] = ("image_name",), label: str = "label", mask: str = "mask",
    classes: Sequence[str] = MASK_CLASSES,
) -> DataFrame:
    """Instance masks -> one mask per class whose name occurs in the label: ``keys..., class, mask``."""
    names = F.array(*[F.lit(c) for c in classes])
    hit = F.filter(names, lambda c: F.contains(F.col(label), c))
    rows = instances.select(*keys, F.explode(hit).alias("class"), F.col(mask).alias(mask))
    return mask_or(rows, [*keys, "class"], mask)


def final_mask(
    instances: DataFrame, images: DataFrame, chosen: Sequence, key: str = "image_name",
    class_id: str = "class_id", mask: str = "mask",
) -> DataFrame:
    """One mask per image over all its instances of the chosen classes; null for an image without any."""
    merged = mask_or(instances.where(F.col(class_id).isin(list(chosen))), [key], mask)
    return images.select(key).join(merged, key, "left")


def class_mask_columns(
    merged: DataFrame, images: DataFrame, key: str = "image_name", classes: Sequence[str] = MASK_CLASSES
) -> DataFrame:
    """One ``<class>_mask`` column per class for every image; a class without instances is all zero.

    ``images``: ``image_name, height, width``.
    """
    picked = merged.groupBy(key).agg(
        *[F.any_value(F.when(F.col("class") == c, F.col("mask")), True).alias(f"{c}_mask") for c in classes]
    )

    @F.pandas_udf("binary")
    def zeros(height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([encode_mask(np.zeros(shape)) for shape in zip(height, width)])

    joined = images.select(key, zeros("height", "width").alias("_zero")).join(picked, key, "left")
    return joined.select(key, *[F.coalesce(f"{c}_mask", "_zero").alias(f"{c}_mask") for c in classes])


def _blanked(pixels: np.ndarray, mask: bytes, fill_mean: bool) -> np.ndarray:
    inside = decode_mask(mask).astype(bool)
    out = np.where(inside[:, :, None], pixels, 0).astype(np.uint8)
    if fill_mean and inside.any():
        out[~inside] = out[inside].mean(axis=0).astype(np.uint8)
    return out


def apply_mask(df: DataFrame, mask: str = "mask", fill_mean: bool = False) -> DataFrame:
    """Blank out the pixels of an image row outside its mask.

    With ``fill_mean`` they take the mean colour inside the mask, cut to whole numbers.
    """

    @F.pandas_udf("binary")
    def blank(image: pd.DataFrame) -> pd.Series:
        return pd.Series([_blanked(_pixels(row), row.mask, fill_mean).tobytes() for row in image.itertuples()])

    image = F.struct("height", "width", "channels", "data", F.col(mask).alias("mask"))
    return df.withColumn("data", blank(image)).drop(mask)


def masked_tiles(
    df: DataFrame, types: Sequence[str], n: int, order: str = "columns", fill_mean: bool = False
) -> DataFrame:
    """n x n tiles of an image row for each of its mask columns, blanked out by that mask.

    Gives the other columns, ``mask_type, tile, height, width, channels, data``. The pixels of an image
    go to Python once for all its masks; a null mask gives no tiles.
    """
    def cut(height: int, width: int, channels: int, data: bytes, *masks: bytes | None) -> Iterator[tuple]:
        pixels = _image(height, width, channels, data)
        for name, mask in zip(types, masks):
            if mask is not None:
                for i, t in _tiles(_blanked(pixels, mask, fill_mean), n, order):
                    yield (name, i, *t.shape, t.tobytes())

    used = ("height", "width", "channels", "data", *types)
    return exploded(df, used, "mask_type string, tile int, height int, width int, channels int, data binary", cut)


def center_crop_resize(images: DataFrame, size: int) -> DataFrame:
    """Centre square, then shrunk to size x size by area: each pixel is the mean of what it covers."""

    def weights(source: int) -> np.ndarray:
        edges = np.linspace(0, source, size + 1)
        low = np.maximum(edges[:-1, None], np.arange(source)[None, :])
        high = np.minimum(edges[1:, None], np.arange(1, source + 1)[None, :])
        return np.maximum(high - low, 0) * (size / source)

    @F.pandas_udf("binary")
    def shrink(image: pd.DataFrame) -> pd.Series:
        def one(row) -> bytes:
            side = min(row.height, row.width)
            y, x = row.height // 2 - side // 2, row.width // 2 - side // 2
            square = _pixels(row)[y : y + side, x : x + side].astype(np.float64)
            w = weights(side)
            small = np.einsum("iy,yxc,jx->ijc", w, square, w, optimize=True)
            return np.rint(np.round(small, 9)).astype(np.uint8).tobytes()

        return pd.Series([one(row) for row in image.itertuples()])

    shrunk = shrink(F.struct("height", "width", "channels", "data"))
    return images.withColumns({"data": shrunk, "height": F.lit(size), "width": F.lit(size)})


# ------------------------------------------------------------------------------------ morphology


def open_close(masks: DataFrame, radius: int, mask: str = "mask", swapped: bool = False) -> DataFrame:
    """``opened`` and ``closed`` masks for a diamond of a radius.

    Opening removes what the diamond does not fit into, closing fills gaps. ``swapped`` exchanges the
    two names, for results made under the other naming.
    """

    @F.pandas_udf("struct<opened:binary, closed:binary>")
    def both(data: pd.Series) -> pd.DataFrame:
        def measured(array: np.ndarray) -> tuple[bytes, bytes]:
            a = array.astype(bool)
            return encode_mask(_dilate(_erode(a, radius), radius)), encode_mask(_erode(_dilate(a, radius), radius))

        found = [_known(measured)(m) or (None, None) for m in data]
        return pd.DataFrame(found, columns=["opened", "closed"], dtype=object)

    rest = [c for c in masks.columns if c != mask]
    first, second = ("closed", "opened") if swapped else ("opened", "closed")
    return masks.select(*rest, both(F.col(mask)).alias("_m")).select(
        *rest, F.col(f"_m.{first}").alias("opened"), F.col(f"_m.{second}").alias("closed")
    )


def connected_components(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """Number of 8-connected regions per mask as ``components``."""

    @F.pandas_udf("int")
    def count(data: pd.Series) -> pd.Series:
        return pd.Series([_known(_components)(m) for m in data], dtype="Int32")

    rest = [c for c in masks.columns if c != mask]
    return masks.select(*rest, count(F.col(mask)).alias("components"))


PROFILE = (
    "iteration:int, opening_mean:double, opening_num_components:int, closing_mean:double, "
    "closing_num_components:int, opening_closing_mean:double, opening_closing_num_components:int"
)


def _profile_column(mask: Column, maximum: int, step: int, swapped: bool) -> Column:
    radii: Iterable[int] = range(step, maximum + 1, step)

    def measures(data: bytes) -> list[tuple]:
        array = decode_mask(data).astype(bool)
        rows, inside, outside = [], _distance(~array), _distance(array)
        for r in radii:
            opened, closed = _dilate(inside > r, r), _erode(outside <= r, r)
            first, second = (closed, opened) if swapped else (opened, closed)
            third = _dilate(_erode(first, r), r) if swapped else _erode(_dilate(first, r), r)
            row: list = [r]
            for m in (first, second, third):
                row += [float(m.mean()), _components(m)]
            rows.append(tuple(row))
        return rows

    @F.pandas_udf(f"array<struct<{PROFILE}>>")
    def profile(data: pd.Series) -> pd.Series:
        return data.map(lambda m: None if m is None else measures(m))

    return profile(mask)


def morph_profile(
    wide: DataFrame, ids: Sequence[str] = ("image_name",), maximum: int = 100, step: int = 10, swapped: bool = False
) -> DataFrame:
    """Mean and regions after opening, closing and both, per image, mask column and radius (rows)."""
    long = unpivot_by_name(wide, ids, "mask", "mask_type", "mask")
    stats = _profile_column(F.col("mask"), maximum, step, swapped)
    return long.select(*ids, "mask_type", F.inline(stats))


def morph_profile_arrays(
    wide: DataFrame, ids: Sequence[str] = ("image_name",), maximum: int = 100, step: int = 10, swapped: bool = False
) -> DataFrame:
    """The same as one ``<mask>_stats`` array column per mask column."""
    masks = [c for c in wide.columns if "mask" in c and c not in ids]
    stats = [_profile_column(F.col(c), maximum, step, swapped).alias(f"{c}_stats") for c in masks]
    return wide.select(*ids, *stats)
