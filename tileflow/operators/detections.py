"""Box detections: suppression of overlaps, label filters and crops.

A detection is one row ``image_name, det_id, x0, y0, x1, y1, score, label``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.operators.numbering import bounded_chunks, top_rows
from tileflow.operators.raster import exploded
from tileflow.sources.tables import settle

# Words that mark a detection as a plant, and the detector's cut-offs.
POSITIVE_WORDS = ("leaves", "flower", "fruit", "plant", "vegetation")
BOX_THRESHOLD = 0.15
NMS_THRESHOLD = 0.25

DETECTION = "image_name string, det_id bigint, x0 double, y0 double, x1 double, y1 double, score double, label string"


def _overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two ``x, y, w, h`` boxes; 0 when both are empty."""

    def side(p: str, size: str) -> Column:
        low = F.greatest(a[p], b[p])
        return F.greatest(F.least(a[p] + a[size], b[p] + b[size]) - low, F.lit(0))

    shared = (side("x", "w") * side("y", "h")).cast("double")
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.coalesce(F.try_divide(shared, union), F.lit(0.0))


def _pixels(box: Column) -> Column:
    """``x, y, w, h`` of a box in whole pixels; they are not carried along, the corners give them."""
    row = box["row"]
    width, height = (row["x1"] - row["x0"]).cast("bigint"), (row["y1"] - row["y0"]).cast("bigint")
    corner = (row["x0"].cast("bigint").alias("x"), row["y0"].cast("bigint").alias("y"))
    return F.struct(*corner, width.alias("w"), height.alias("h"))


def _greedy(boxes: DataFrame, iou: float) -> DataFrame:
    """Kept boxes of each image: best first, a box is dropped when it overlaps a kept one too much.

    The images passed in have a bounded number of boxes.
    """
    boxes = boxes.groupBy("image").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    box = boxes.schema["boxes"].dataType.simpleString()
    kept = F.aggregate(
        "boxes",
        F.array().cast(box),
        lambda acc, b: F.when(F.exists(acc, lambda k: _overlap(_pixels(k), _pixels(b)) > iou), acc).otherwise(F.array_append(acc, b)),
    )
    return boxes.select("image", kept.alias("kept"), F.element_at("boxes", -1).alias("last"), F.size("boxes").alias("n"))


def detections_nms(
    df: DataFrame, score: float = BOX_THRESHOLD, iou: float = NMS_THRESHOLD, crowd: int = 2000
) -> DataFrame:
    """Greedy non-maximum suppression per image, all labels together.

    Boxes are cut to whole pixels; a box needs a score above ``score`` and falls to a better box of its
    image when they overlap by more than ``iou``. Equal scores go by ``det_id``. An image with more
    than ``crowd`` boxes is settled in rounds: the best ``crowd`` open boxes are decided, everything
    that overlaps a kept one is dropped, and the next best follow, so no image is held at once.
    """
    others = [c for c in df.columns if c not in ("image_name", "det_id", "score")]
    box = F.struct(
        (-F.col("score")).alias("neg"),
        "det_id",
        F.struct(*others).alias("row"),
    )
    # the name travels in a struct, so that boxes without a name are an image like others
    boxes = df.where(F.col("score") > score).select(F.struct("image_name").alias("image"), box.alias("box"))
    crowded = boxes.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    if crowded.isEmpty():
        decided = [_greedy(boxes, iou)]
    else:
        decided = []
        # repeated boxes differ by a number, so that a round ends between them and not beside them
        number = F.monotonically_increasing_id().alias("number")
        rest = settle(boxes.select("image", F.struct("box.*", number).alias("box")), "boxes")
        while not rest.isEmpty():
            best = top_rows(rest, ["image"], ["box"], crowd).drop("rank")
            done = settle(_greedy(best, iou), "kept")
            decided.append(done)
            corners = F.transform("kept", _pixels).alias("kept")
            full = done.where(F.col("n") == crowd).select("image", corners, "last")  # only these have more boxes
            hit = F.exists("kept", lambda k: _overlap(k, _pixels(F.col("box"))) > iou)
            rest = rest.join(full, "image").where((F.col("box") > F.col("last")) & ~hit)
            rest = settle(rest.select("image", "box"), "boxes")
    named = {"image_name": "image.image_name", "det_id": "b.det_id"} | {c: f"b.row.`{c}`" for c in others}
    columns = [F.col(named[c]).alias(c) if c in named else (-F.col("b.neg")).alias(c) for c in df.columns]
    rows = [d.select("image", F.explode("kept").alias("b")).select(*columns) for d in decided]
    return reduce(DataFrame.unionAll, rows)


def positive_labels(df: DataFrame, words: Sequence[str] = POSITIVE_WORDS, label: str = "label") -> DataFrame:
    """Detections whose label contains one of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.col(label).contains(word)
    return df.where(hit)


def crop_boxes(images: DataFrame, detections: DataFrame, together: int = 256) -> DataFrame:
    """One image row per box (whole pixels, parts outside the image are black).

    The boxes of an image travel as one array, so its pixels are joined and sent to Python once; an image
    with more than about ``together`` boxes is split into several such arrays.
    """

    def crop(pixels: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> tuple:
        out = np.zeros((max(y1 - y0, 0), max(x1 - x0, 0), pixels.shape[2]), np.uint8)
        top, left, bottom, right = max(y0, 0), max(x0, 0), min(y1, pixels.shape[0]), min(x1, pixels.shape[1])
        if bottom > top and right > left:
            out[top - y0 : bottom - y0, left - x0 : right - x0] = pixels[top:bottom, left:right]
        return (*out.shape, out.tobytes())

    def every(height: int, width: int, channels: int, data: bytes, corners: list[list[int]]) -> Iterator[tuple]:
        pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        return (crop(pixels, *box) for box in corners)

    names = detections.columns
    counts = detections.groupBy("image_name").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("det_id", "x0", "y0"), F.greatest(F.ceil(F.col("_n") / together), F.lit(1)))
    grouped = (
        detections.join(counts, "image_name")
        .groupBy("image_name", part.alias("_part"))
        .agg(F.collect_list(F.struct(*names)).alias("_boxes"))
    )
    joined = grouped.join(images.select("image_name", "height", "width", "channels", "data"), "image_name")
    corners = F.transform("_boxes", lambda b: F.array(*[b[c].cast("int") for c in ("x0", "y0", "x1", "y1")]))
    used = ("height", "width", "channels", "data", "_corners")
    made = "height int, width int, channels int, data binary"
    cut = exploded(joined.select("_boxes", *used[:-1], corners.alias("_corners")), used, made, every, "_boxes")
    return cut.select("_boxes.*", "height", "width", "channels", "data")


def _parallel_arrays(df: DataFrame, *keys: str) -> DataFrame:
    entry = F.struct((-F.col("score")).alias("neg"), "det_id", "x0", "y0", "x1", "y1", "label", "data")
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_d"))
    corners = ("x0", "y0", "x1", "y1")
    return lists.select(
        *keys,
        F.transform("_d", lambda e: e["data"]).alias("extracted_bbox"),
        F.transform("_d", lambda e: F.array(*[e[c].cast("int") for c in corners])).alias("boxes"),
        F.transform("_d", lambda e: -e["neg"]).alias("scores"),
        F.transform("_d", lambda e: e["label"]).alias("text_labels"),
    )


def detection_arrays(df: DataFrame) -> DataFrame:
    """Detection rows -> one row per image with parallel arrays, best score first."""
    return _parallel_arrays(df, "image_name")


def detection_chunks(df: DataFrame, size: int = 1000, most: int = 64 << 20) -> DataFrame:
    """The same in rows ``image_name, chunk, ...`` of at most ``size`` boxes and about ``most`` bytes of crops.

    Scores fall from chunk to chunk as inside one. So an image may have any number of boxes.
    """
    order = [F.desc("score"), "det_id", "x0", "y0", "x1", "y1"]
    return _parallel_arrays(bounded_chunks(df, ["image_name"], order, size, F.length("data"), most), "image_name", "chunk")


def detect(
    images: DataFrame, make_detector: Callable[[], Callable], score: float = BOX_THRESHOLD, iou: float = NMS_THRESHOLD,
    words: Sequence[str] = POSITIVE_WORDS,
) -> DataFrame:
    """Run a detector and keep its plants: ``image_name, det_id, box, score, label`` and the crop.

    ``make_detector()`` is called once per task and gives ``f(pixels) -> [(x0, y0, x1, y1, score, label)]``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make_detector()
        names = [c.split()[0] for c in DETECTION.split(", ")]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows += [(r.image_name, i, *map(float, d[:5]), d[5]) for i, d in enumerate(find(pixels))]
            yield pd.DataFrame(rows, columns=names)

    source = images.select("image_name", "height", "width", "channels", "data")
    found = settle(source.mapInPandas(run, DETECTION), "detections")
    return crop_boxes(images, positive_labels(detections_nms(found, score, iou), words))
