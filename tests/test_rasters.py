import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileflow.operators import detections as det, raster
from tileflow.sources.tables import settle


def mask_table(spark, arrays, **extra):
    rows = [(f"m{i}", bytearray(raster.encode_mask(a))) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_name string, mask binary")


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(2)
    shapes = [(17, 23), (30, 30), (1, 9), (12, 5)]
    out = [(rng.random(s) < p).astype(np.uint8) for s in shapes for p in (0.2, 0.45, 0.7)]
    return out + [np.zeros((6, 6), np.uint8), np.ones((6, 6), np.uint8)]


def flood(mask):
    """Number of 8-connected regions by flood fill."""
    open_cells = set(zip(*np.nonzero(mask)))
    n = 0
    while open_cells:
        n += 1
        todo = [open_cells.pop()]
        while todo:
            y, x = todo.pop()
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                if (y + dy, x + dx) in open_cells:
                    open_cells.remove((y + dy, x + dx))
                    todo.append((y + dy, x + dx))
    return n


def diamond(mask, r, grow):
    out = np.zeros_like(mask)
    h, w = mask.shape
    for y, x in itertools.product(range(h), range(w)):
        near = [mask[a, b] for a in range(max(0, y - r), min(h, y + r + 1)) for b in range(max(0, x - r), min(w, x + r + 1))
                if abs(a - y) + abs(b - x) <= r]
        out[y, x] = max(near) if grow else min(near)
    return out


def test_codec(arrays):
    for a in arrays:
        assert np.array_equal(raster.decode_mask(raster.encode_mask(a)), a)


def test_components(spark, arrays):
    got = {r.image_name: r.components for r in raster.connected_components(mask_table(spark, arrays)).collect()}
    assert got == {f"m{i}": flood(a) for i, a in enumerate(arrays)}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_open_close(spark, arrays, radius):
    out = raster.open_close(mask_table(spark, arrays), radius)
    for r in out.collect():
        a = arrays[int(r.image_name[1:])]
        opened, closed = raster.decode_mask(r.opened), raster.decode_mask(r.closed)
        assert np.array_equal(opened, diamond(diamond(a, radius, False), radius, True))
        assert np.array_equal(closed, diamond(diamond(a, radius, True), radius, False))
        assert (opened <= a).all() and (a <= closed).all()
    again = raster.open_close(out.select("image_name", F.col("opened").alias("mask")), radius)
    same = again.join(out.select("image_name", F.col("opened").alias("before")), "image_name").where("opened = before")
    assert same.count() == len(arrays)


def test_swapped_names(spark, arrays):
    plain = raster.open_close(mask_table(spark, arrays), 1)
    swapped = raster.open_close(mask_table(spark, arrays), 1, swapped=True)
    both = plain.join(swapped.withColumnsRenamed({"opened": "o", "closed": "c"}), "image_name")
    assert both.where("opened = c and closed = o").count() == len(arrays)


@pytest.mark.parametrize("swapped", [False, True])
def test_profile(spark, arrays, swapped):
    wide = mask_table(spark, arrays).select("image_name", F.col("mask").alias("plant_mask"), F.col("mask").alias("rock_mask"))
    rows = raster.morph_profile(wide, maximum=6, step=2, swapped=swapped).collect()
    assert len(rows) == len(arrays) * 2 * 3
    for r in rows:
        if r.mask_type == "rock_mask" and r.iteration == 4:
            continue
        a = arrays[int(r.image_name[1:])]

        def opened(m):
            return diamond(diamond(m, r.iteration, False), r.iteration, True)

        def closed(m):
            return diamond(diamond(m, r.iteration, True), r.iteration, False)

        first, second = (closed, opened) if swapped else (opened, closed)
        for name, m in (("opening", first(a)), ("closing", second(a)), ("opening_closing", second(first(a)))):
            assert r[f"{name}_mean"] == pytest.approx(m.mean())
            assert r[f"{name}_num_components"] == flood(m)
    nested = raster.morph_profile_arrays(wide, maximum=6, step=2).first()
    assert [e.iteration for e in nested.plant_mask_stats] == [2, 4, 6]


def test_mask_or_over_many_tasks(spark):
    rng = np.random.default_rng(4)
    arrays = [(rng.random((8, 8)) < 0.05).astype(np.uint8) for _ in range(300)]
    groups = ["hot" if i % 3 else f"g{i % 90}" for i in range(300)]
    rows = [(g, i, bytearray(raster.encode_mask(a))) for i, (g, a) in enumerate(zip(groups, arrays))]
    df = spark.createDataFrame(rows, "image_name string, i int, mask binary").repartition(6)
    got = {r.image_name: raster.decode_mask(r.mask) for r in raster.mask_or(df, ["image_name"]).collect()}
    assert got.keys() == set(groups)
    for g in got:
        assert np.array_equal(got[g], np.bitwise_or.reduce([a for a, k in zip(arrays, groups) if k == g]))


def images(spark, shapes):
    rng = np.random.default_rng(6)
    pixels = [rng.integers(0, 256, s, dtype=np.uint8) for s in shapes]
    rows = [(f"i{i}", *p.shape, bytearray(p.tobytes())) for i, p in enumerate(pixels)]
    return spark.createDataFrame(rows, "image_name string, height int, width int, channels int, data binary"), pixels


@pytest.mark.parametrize("order", ["columns", "rows"])
def test_tiles_cover_the_cropped_image(spark, order):
    df, pixels = images(spark, [(10, 13, 3), (9, 9, 1)])
    for r in raster.tile_image(df, 3, order).collect():
        p = pixels[int(r.image_name[1:])]
        h, w = p.shape[0] // 3, p.shape[1] // 3
        row, col = (r.tile % 3, r.tile // 3) if order == "columns" else (r.tile // 3, r.tile % 3)
        assert bytes(r.data) == p[row * h : row * h + h, col * w : col * w + w].tobytes()
    assert sorted(r.tile for r in raster.tile_image(df, 2).where("image_name = 'i0'").collect()) == [0, 1, 2, 3]


def test_resize_keeps_flat_images_and_means(spark):
    df, pixels = images(spark, [(12, 20, 3), (7, 7, 3)])
    for r in raster.center_crop_resize(df, 4).collect():
        p = pixels[int(r.image_name[1:])]
        side = min(p.shape[:2])
        y, x = p.shape[0] // 2 - side // 2, p.shape[1] // 2 - side // 2
        small = np.frombuffer(r.data, np.uint8).reshape(4, 4, 3)
        assert abs(small.mean() - p[y : y + side, x : x + side].mean()) < 1
        if side == 12:
            want = p[y : y + 12, x : x + 12].reshape(4, 3, 4, 3, 3).mean((1, 3))
            assert np.abs(small - want).max() <= 0.5


def greedy(boxes, score, iou):
    kept = []
    for b in sorted((b for b in boxes if b[6] > score), key=lambda b: (-b[6], b[1])):
        x, y, w, h = int(b[2]), int(b[3]), int(b[4] - b[2]), int(b[5] - b[3])
        for kx, ky, kw, kh, _ in kept:
            s = max(0, min(x + w, kx + kw) - max(x, kx)) * max(0, min(y + h, ky + kh) - max(y, ky))
            if s / (w * h + kw * kh - s) > iou:
                break
        else:
            kept.append((x, y, w, h, b[1]))
    return {k[4] for k in kept}


@pytest.mark.parametrize("crowd", [25, 2000])
def test_nms_in_rounds(spark, crowd):
    """The crowded image is settled in rounds, with the same outcome."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        image = "hot" if i < 200 else f"i{i % 20}"
        x, y = rng.uniform(0, 90, 2).tolist()
        w, h = rng.uniform(8, 30, 2).tolist()
        rows.append((image, i, x, y, x + w, y + h, float(np.round(rng.uniform(0, 1), 2)), "plant"))
    df = spark.createDataFrame(rows, det.DETECTION).repartition(5)
    kept = det.detections_nms(df, 0.15, 0.25, crowd)
    want = {(r[0], i) for r in rows for i in greedy([b for b in rows if b[0] == r[0]], 0.15, 0.25)}
    assert {(r.image_name, r.det_id) for r in kept.collect()} == want
    again = det.detections_nms(kept, 0.15, 0.25, crowd)
    assert again.count() == len(want)


def test_crops_outside_the_image_are_black(spark):
    df, pixels = images(spark, [(6, 8, 3)])
    boxes = spark.createDataFrame([("i0", 1, -2.0, 1.9, 3.0, 4.0, 0.5, "plant"), ("i0", 2, 6.0, 4.0, 11.0, 9.0, 0.5, "plant")], det.DETECTION)
    got = {r.det_id: r for r in det.crop_boxes(df, boxes, together=1).collect()}
    first = np.frombuffer(got[1].data, np.uint8).reshape(got[1].height, got[1].width, 3)
    assert first.shape == (3, 5, 3) and (first[:, :2] == 0).all() and np.array_equal(first[:, 2:], pixels[0][1:4, 0:3])
    second = np.frombuffer(got[2].data, np.uint8).reshape(5, 5, 3)
    assert np.array_equal(second[:2, :2], pixels[0][4:6, 6:8]) and (second[2:] == 0).all()


def test_class_masks_fill_absent_classes(spark):
    ones = np.ones((3, 4), np.uint8)
    inst = spark.createDataFrame([("a", "all leaf", bytearray(raster.encode_mask(ones)))], "image_name string, label string, mask binary")
    shapes = spark.createDataFrame([("a", 3, 4), ("b", 2, 2)], "image_name string, height int, width int")
    wide = {r.image_name: r for r in raster.class_mask_columns(raster.class_mask_merge(inst), shapes).collect()}
    assert list(wide["a"].asDict()) == ["image_name", *[f"{c}_mask" for c in raster.MASK_CLASSES]]
    assert raster.decode_mask(wide["a"].leaf_mask).sum() == 12
    assert raster.decode_mask(wide["b"].rock_mask).shape == (2, 2) and raster.decode_mask(wide["b"].leaf_mask).sum() == 0


def test_rows_made_in_python_come_back_in_bounded_batches(spark, monkeypatch):
    """Tiles and crops of many images do not gather in one batch, and each stays beside its own row."""
    monkeypatch.setattr(raster, "_OUT_ROWS", 5)
    pixels = [np.random.default_rng(i).integers(0, 256, (4, 6, 3), dtype=np.uint8) for i in range(7)]
    rows = [(f"i{i}", 4, 6, 3, bytearray(p.tobytes())) for i, p in enumerate(pixels)]
    images = spark.createDataFrame(rows, "image_name string, height int, width int, channels int, data binary").coalesce(1)
    tiles = raster.tile_image(images, 2)
    found = tiles.collect()
    assert len(found) == 28
    for r in found:
        y, x = 2 * (r.tile % 2), 3 * (r.tile // 2)
        assert bytes(r.data) == pixels[int(r.image_name[1:])][y : y + 2, x : x + 3].tobytes()
    boxes = [(f"i{i}", j, j % 3, j % 2, j % 3 + 2, j % 2 + 3, 0.5, f"b{j}") for i in range(7) for j in range(20)]
    boxes.append((None, 1, 0, 0, 1, 1, 0.5, None))
    df = spark.createDataFrame(boxes, "image_name string, det_id bigint, x0 int, y0 int, x1 int, y1 int, score double, label string")
    crops = det.crop_boxes(images, df, together=8).collect()
    assert len(crops) == 140
    for r in crops:
        assert r.label == f"b{r.det_id}" and (r.height, r.width) == (3, 2)
        assert bytes(r.data) == pixels[int(r.image_name[1:])][r.y0 : r.y1, r.x0 : r.x1].tobytes()


def test_pixels_of_opened_and_closed_come_from_one_row(spark):
    """No join of pixels: the plan of the open-close job has neither a broadcast nor a shuffle of them."""
    from checks import rasters as jobs

    made = spark.createDataFrame([("a", bytearray(raster.encode_mask(np.eye(4)))), ("b", None)], "image_name string, mask binary")
    out = jobs.mask_pixels(raster.open_close(made, 1), ["image_name"], opened="opened", closed="closed")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["image_name", "y", "x", "opened", "closed"] and out.count() == 16


def test_crowded_boxes_travel_once_and_narrow(spark, monkeypatch):
    """A round writes the boxes without a second copy of their name, id and score; no table of crowded images is joined."""
    rng = np.random.default_rng(3)
    rows = [(f"i{i % 5}", i, *map(float, (x := rng.integers(0, 60, 2))), *map(float, x + 30), float(rng.random()), "leaves")
            for i in range(60)]
    df = spark.createDataFrame(rows, det.DETECTION)
    written = []
    monkeypatch.setattr(det, "settle", lambda df, label: written.append((label, df.schema)) or settle(df, label))
    few = sorted(map(tuple, det.detections_nms(df, crowd=2).collect()))
    assert few == sorted(map(tuple, det.detections_nms(df).collect())) and len(few) > 10
    label, schema = written[0]
    assert label == "boxes" and "crowded" not in {label for label, _ in written}
    assert schema["box"].dataType.names == ["neg", "det_id", "row", "number"]
    assert schema["box"].dataType["row"].dataType.names == ["x0", "y0", "x1", "y1", "label"]
