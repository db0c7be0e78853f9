"""Images, masks and detections. Every supplier has one image and one set of masks, given by a formula."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from tileflow.operators import counting, detections as det, raster
from tileflow.operators.joins import join_mask_image
from tileflow.plans import ingest, masks as mask_plans, morphology
from tileflow.sources import readers, writers
from tileflow.sources.tables import new_path, settle

H, W = v.H, v.W


def mask_column(key, shift):
    @F.pandas_udf("binary")
    def build(keys: pd.Series) -> pd.Series:
        y, x = np.mgrid[:H, :W]
        return keys.map(lambda s: raster.encode_mask((y * 7 + x * 13 + s * 5 + y * x + shift * 3) % 11 < 5))

    return build(F.col(key))


def names(spark, d):
    """The table is one small file: spread the keys, so that all cores make and handle images."""
    return v.table(spark, d, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey").select(
        "s_suppkey", F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("image_name"))


def masks(spark, d, shift=0):
    return names(spark, d).select("image_name", mask_column("s_suppkey", shift).alias("mask"))


def wide_masks(spark, d):
    return names(spark, d).select(
        "image_name", *[mask_column("s_suppkey", i).alias(f"{c}_mask") for i, c in enumerate(raster.MASK_CLASSES)])


def images(spark, d):
    @F.pandas_udf("binary")
    def build(keys: pd.Series) -> pd.Series:
        y, x, c = np.mgrid[:H, :W, :3]
        return keys.map(lambda s: ((y * 7 + x * 13 + s * 5 + y * x + c * 17) % 256).astype(np.uint8).tobytes())

    return names(spark, d).select(
        "image_name", F.lit(H).alias("height"), F.lit(W).alias("width"), F.lit(3).alias("channels"),
        build("s_suppkey").alias("data"))


def mask_pixels(df, keep, **masks):
    """Mask rows -> one row per pixel: ``y, x`` and the pixel of each mask column (``v`` of ``mask``, or as named).

    The masks of a row have one shape. Pixels leave Python in batches of about a quarter of a million.
    """
    masks = masks or {"v": "mask"}
    source = df.select(*keep, *[F.col(c).alias(f"_{n}") for n, c in masks.items()])
    schema = source.select(*keep).schema
    for name in ("y", "x", *masks):
        schema = schema.add(name, "integer")

    def spread(batches):
        for batch in batches:
            kept = [batch.column(i) for i in range(len(keep))]
            at, held, count = [], [], 0

            def close():
                rows = pa.array(np.repeat(at, [len(p[0]) for p in held]))
                pixels = [pa.array(np.concatenate(c)) for c in zip(*held)]
                return pa.RecordBatch.from_arrays([*[k.take(rows) for k in kept], *pixels], schema.names)

            for i in range(batch.num_rows):
                found = [batch.column(j)[i].as_py() for j in range(len(keep), batch.num_columns)]
                if None in found:
                    continue
                arrays = [raster.decode_mask(m) for m in found]
                y, x = np.indices(arrays[0].shape, dtype=np.int32)
                at.append(i)
                held.append([y.ravel(), x.ravel(), *[a.ravel().astype(np.int32) for a in arrays]])
                count += y.size
                if count >= 1 << 18:
                    yield close()
                    at, held, count = [], [], 0
            if held:
                yield close()

    return source.mapInArrow(spread, schema)


def image_sums(df, keep):
    """A position-weighted sum of all pixels per image row: equal only for equal pixels in equal places."""
    @F.pandas_udf("struct<total:bigint, weighted:bigint>")
    def sums(data: pd.Series) -> pd.DataFrame:
        arrays = [np.frombuffer(b, np.uint8).astype(np.int64) for b in data]
        return pd.DataFrame({"total": [a.sum() for a in arrays],
                             "weighted": [(a * (np.arange(len(a)) % 101 + 1)).sum() for a in arrays]})

    return df.select(*keep, sums("data").alias("_s")).select(*keep, "_s.*")


MASK = v.masks_sql()


def tiled(table, n, by="columns", extra="", keep="image_name"):
    """SQL: pixels of ``table`` with tile number and the position in the tile."""
    h, w = H // n, W // n
    tile = f"(x // {w}) * {n} + y // {h}" if by == "columns" else f"(y // {h}) * {n} + x // {w}"
    return f"""tiled as (select {keep}, ({tile})::int tile, y % {h} ty, x % {w} tx, {extra} v from {table}
      where y < {h * n} and x < {w * n})"""


@query("ras01_tile_image", f"""with {v.PIXELS}, {tiled("px", 3, extra="c,")}
  select image_name, tile, {H // 3} height, {W // 3} width, sum(v)::bigint total,
  sum(v * (((ty * {W // 3} + tx) * 3 + c) % 101 + 1))::bigint weighted from tiled group by 1, 2""")
def tile_image(spark, d):
    return image_sums(raster.tile_image(images(spark, d), 3), ["image_name", "tile", "height", "width"])


@query("ras02_tile_mask", f"with {MASK}, {tiled('mask_px', 3)} select image_name, tile, ty y, tx x, v from tiled")
def tile_mask(spark, d):
    return mask_pixels(raster.tile_mask(masks(spark, d), 3), ["image_name", "tile"])


@query("ras02_tile_mask_rows", f"with {MASK}, {tiled('mask_px', 4, 'rows')} select image_name, tile, ty y, tx x, v from tiled")
def tile_mask_rows(spark, d):
    return mask_pixels(raster.tile_mask(masks(spark, d), 4, order="rows"), ["image_name", "tile"])


@query("ras03_tile_coverage", f"with {MASK}, {tiled('mask_px', 3)} select image_name, tile, round(avg(v), 6) pct_covered from tiled group by all")
def tile_coverage(spark, d):
    out = raster.tile_coverage(masks(spark, d), 3)
    return out.withColumn("pct_covered", F.round("pct_covered", 6))


COUNTS = ", ".join(f"""t{n} as (select image_name, {n} n, count(*) filter (where m > 0.48)::int covered_tiles from (
  select image_name, y // {H // n} ty, x // {W // n} tx, avg(v) m from mask_px
  where y < {H // n * n} and x < {W // n * n} group by all) group by all)""" for n in (3, 4, 5, 6))
COUNTED = f"with {MASK}, {COUNTS}, counts as (" + " union all ".join(f"select * from t{n}" for n in (3, 4, 5, 6)) + ")"


@query("ras04_covered_tile_count", COUNTED + " select * from counts")
def covered_tiles(spark, d):
    return raster.covered_tile_count(masks(spark, d), (3, 4, 5, 6), 0.48)


@query("agg28_grid_coverage", COUNTED + """ select n, sum(n * n)::bigint total_tiles, sum(covered_tiles)::bigint covered_tiles,
  round(sum(covered_tiles) / sum(n * n), 6) ratio from counts group by 1""")
def grid_coverage(spark, d):
    out = counting.grid_coverage(raster.covered_tile_count(masks(spark, d), (3, 4, 5, 6), 0.48))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("ras05_mask_stats", f"with {MASK} select image_name, count(*) total, sum(v)::bigint covered, round(avg(v), 6) mean from mask_px group by 1")
def mask_stats(spark, d):
    return raster.mask_stats(masks(spark, d)).withColumn("mean", F.round("mean", 6))


ALL = ", ".join(v.masks_sql(f"m{i}", i) for i in range(9))
LONG = f"with {ALL}, long as (" + " union all ".join(
    f"select '{c}_mask' mask_type, * from m{i}" for i, c in enumerate(raster.MASK_CLASSES)) + ")"


def long_masks(spark, d):
    return raster.unpivot_by_name(wide_masks(spark, d), ["image_name"], "mask", "mask_type", "mask")


@query("agg27_coverage_ratio", LONG + " select mask_type, round(sum(v) / count(*), 3) coverage from long group by 1")
def coverage_by_type(spark, d):
    return counting.coverage_ratio(raster.mask_stats(long_masks(spark, d)), ["mask_type"])


@query("agg27_coverage_ratio_overall", LONG + " select round(sum(v) / count(*), 3) coverage from long")
def coverage_overall(spark, d):
    return counting.coverage_ratio(raster.mask_stats(long_masks(spark, d)))


OR3 = LONG + """, merged as (select image_name, y, x, max(v) v from long
  where mask_type in ('plant_mask', 'flower_mask', 'leaf_mask') group by all)"""


@query("ras06_merge_masks", OR3 + " select image_name, y, x, v from merged")
def merge_masks(spark, d):
    return mask_pixels(raster.merge_masks(wide_masks(spark, d)), ["image_name"])


@query("agg33_mask_or", OR3 + " select image_name, y, x, v from merged")
def mask_or(spark, d):
    chosen = long_masks(spark, d).where(F.col("mask_type").isin(*raster.POSITIVE_MASKS))
    return mask_pixels(raster.mask_or(chosen, ["image_name"]), ["image_name"])


MASKED = f"with {v.PIXELS}, {MASK}, j as (select p.*, m.v keep, sum(m.v) over (partition by p.image_name, c) n, " \
         "sum(m.v * p.v) over (partition by p.image_name, c) s from px p join mask_px m using (image_name, y, x))"
SUMS = f"sum(o)::bigint total, sum(o * (((y * {W} + x) * 3 + c) % 101 + 1))::bigint weighted"


@query("ras07_jon06_apply_mask", MASKED + f", o as (select *, v * keep o from j) select image_name, {SUMS} from o group by 1")
def apply_mask(spark, d):
    joined = join_mask_image(masks(spark, d), images(spark, d))
    return image_sums(raster.apply_mask(joined), ["image_name"])


@query("ras07_apply_mask_fill_mean", MASKED + f""", o as (select *, case when keep = 1 then v else floor(s / n)::bigint end o from j)
  select image_name, {SUMS} from o group by 1""")
def apply_mask_fill(spark, d):
    joined = join_mask_image(masks(spark, d), images(spark, d))
    return image_sums(raster.apply_mask(joined, fill_mean=True), ["image_name"])


def shifted(name, source, how, outside):
    """SQL: one diamond step; ``max`` grows, ``min`` shrinks."""
    return f"""{name} as (select a.image_name, a.y, a.x, {how}(coalesce(b.v, {outside})) v from {source} a
      cross join (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dy, dx)
      left join {source} b on b.image_name = a.image_name and b.y = a.y + dy and b.x = a.x + dx group by all)"""


@query("ras08_open_close", f"""with {MASK}, {shifted("e1", "mask_px", "min", 1)}, {shifted("op", "e1", "max", 0)},
  {shifted("d1", "mask_px", "max", 0)}, {shifted("cl", "d1", "min", 1)}
  select op.image_name, op.y, op.x, op.v opened, cl.v closed from op join cl using (image_name, y, x)""")
def open_close(spark, d):
    out = raster.open_close(masks(spark, d), 1)
    return mask_pixels(out, ["image_name"], opened="opened", closed="closed")


@query("ras09_connected_components", f"""with recursive {MASK}, on_px as (select image_name, y, x, y * {W} + x id from mask_px where v = 1),
  edge as (select a.image_name, a.id a, b.id b from on_px a join on_px b on a.image_name = b.image_name
    and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
  reach as (select image_name, id root, id from on_px union
    select r.image_name, r.root, e.b from reach r join edge e on e.image_name = r.image_name and e.a = r.id where e.b > r.root),
  least as (select image_name, id, min(root) root from reach group by all)
  select image_name, count(*) filter (where id = root)::int components from least group by 1""")
def components(spark, d):
    return raster.connected_components(masks(spark, d))


@query("ras10_morph_profile")
def morph_profile(spark, d):
    out = raster.morph_profile(wide_masks(spark, d), maximum=6, step=2)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_mean")})


@query("agg10_morph_whiskers")
def morph_whiskers(spark, d):
    out = settle(raster.morph_profile(wide_masks(spark, d), maximum=6, step=2))
    return counting.whisker_stats(out, ["iteration"], ["opening_mean", "closing_mean"])


@query("ras11_center_crop_resize", f"""with {v.PIXELS}, sq as (select image_name, c, y // 4 y, (x - 2) // 4 x, round_even(avg(v), 0)::bigint o
  from px where x between 2 and 21 group by all)
  select image_name, 5 height, 5 width, sum(o)::bigint total, sum(o * (((y * 5 + x) * 3 + c) % 101 + 1))::bigint weighted from sq group by 1""")
def crop_resize(spark, d):
    return image_sums(raster.center_crop_resize(images(spark, d), 5), ["image_name", "height", "width"])


@query("ras12_filter_by_mask", OR3 + f""", {tiled("merged", 3)}, cov as (select image_name, tile, avg(v) pct from tiled group by all),
  emb as (select concat('m', vec_id // 9) image_name, (vec_id % 9)::int tile, vec_id from embeddings)
  select image_name, tile, vec_id, round(pct, 6) pct_covered from emb join cov using (image_name, tile) where pct > 0.7""")
def filter_by_mask(spark, d):
    e = v.table(spark, d, "embeddings").select(
        F.concat(F.lit("m"), F.floor(F.col("vec_id") / 9).cast("string")).alias("image_name"),
        (F.col("vec_id") % 9).cast("int").alias("tile"), "vec_id")
    out = mask_plans.filter_by_mask(e, wide_masks(spark, d), 3).where("pct_covered > 0.7")
    return out.withColumn("pct_covered", F.round("pct_covered", 6))


@query("ras13_class_mask_merge", LONG + """, inst as (select image_name, y, x, v, case mask_type when 'leaf_mask' then 'all leaf'
    when 'rock_mask' then 'rock and sand' when 'sand_mask' then 'all sand' when 'tree_mask' then 'tree' else 'shadow' end label from long),
  hit as (select image_name, y, x, v, c class from inst join (values ('leaf'), ('rock'), ('sand'), ('tree')) k(c) on contains(label, c))
  select image_name, class, y, x, max(v) v from hit group by all""")
def class_masks(spark, d):
    label = (F.when(F.col("mask_type") == "leaf_mask", "all leaf").when(F.col("mask_type") == "rock_mask", "rock and sand")
             .when(F.col("mask_type") == "sand_mask", "all sand").when(F.col("mask_type") == "tree_mask", "tree").otherwise("shadow"))
    merged = raster.class_mask_merge(long_masks(spark, d).withColumn("label", label))
    return mask_pixels(merged, ["image_name", "class"])


@query("ras13_final_mask", LONG + f""", inst as (select image_name, y, x, v from long where mask_type in ('leaf_mask', 'rock_mask')),
  fin as (select image_name, y, x, max(v) v from inst group by all)
  select image_name, sum(v)::bigint covered, sum(v * ((y * {W} + x) % 101 + 1))::bigint weighted from fin group by 1
  union all select 'none', null, null""")
def final_mask(spark, d):
    """Instances of two chosen classes; one image has none of them."""
    long = long_masks(spark, d).withColumnRenamed("mask_type", "class_id")
    ids = long.select("image_name").distinct()
    one = ids.limit(1).select(F.lit("none").alias("image_name"))
    out = raster.final_mask(long, ids.union(one), ["leaf_mask", "rock_mask"])
    pixels = mask_pixels(out.where("mask is not null"), ["image_name"]).groupBy("image_name").agg(
        F.sum("v").alias("covered"), F.sum(F.col("v") * ((F.col("y") * W + F.col("x")) % 101 + 1)).alias("weighted"))
    return out.select("image_name").join(pixels, "image_name", "left")


# ----------------------------------------------------------------------------------- detections

DET_ID = "(l_partkey * 10000000000 + round(l_extendedprice * 100)::bigint * 10 + l_linenumber)"
DET = f"""det as (select concat('d', l_orderkey) image_name, {DET_ID} det_id,
  (l_partkey % 60)::int x0, (l_suppkey % 60)::int y0, (l_partkey % 60)::int + 20 + l_quantity::int x1,
  (l_suppkey % 60)::int + 20 + l_quantity::int y1, l_discount * 10 + l_tax score,
  case l_returnflag when 'R' then 'sand' when 'A' then 'all leaves' else 'single plant' end "label" from lineitem)"""


def det_id():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (F.col("l_partkey") * 10_000_000_000 + cents * 10 + F.col("l_linenumber")).alias("det_id")


def detections(spark, d):
    line = v.table(spark, d, "lineitem")
    x0, y0 = (F.col("l_partkey") % 60).cast("int"), (F.col("l_suppkey") % 60).cast("int")
    size = 20 + F.col("l_quantity").cast("int")
    label = F.when(F.col("l_returnflag") == "R", "sand").when(F.col("l_returnflag") == "A", "all leaves").otherwise("single plant")
    return line.select(
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("image_name"),
        det_id(),
        x0.alias("x0"), y0.alias("y0"), (x0 + size).alias("x1"), (y0 + size).alias("y1"),
        (F.col("l_discount") * 10 + F.col("l_tax")).alias("score"), label.alias("label"))


NMS = f"""with recursive {DET}, r as (select *, row_number() over (partition by image_name order by score desc, det_id) k
    from det where score > 0.15),
  step as (select image_name, 1::bigint k, [{{'id': det_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] kept from r where k = 1
    union all
    select s.image_name, r.k, case when len(list_filter(s.kept, lambda b:
        greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0)
        / ((b.x1 - b.x0) * (b.y1 - b.y0) + (r.x1 - r.x0) * (r.y1 - r.y0)
           - greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0)) > 0.25)) > 0
      then s.kept else list_append(s.kept, {{'id': r.det_id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) end
    from step s join r on r.image_name = s.image_name and r.k = s.k + 1),
  fin as (select image_name, arg_max(kept, k) kept from step group by 1)
  select image_name, unnest(kept).id det_id from fin"""


@query("ras14_detections_nms", NMS)
def nms(spark, d):
    return det.detections_nms(detections(spark, d)).select("image_name", "det_id")


@query("ras14_detections_nms_crowded", NMS)
def nms_crowded(spark, d):
    return det.detections_nms(detections(spark, d), crowd=2).select("image_name", "det_id")


@query("ras15_positive_labels", f"""with {DET} select image_name, det_id, "label" from det
  where contains("label", 'leaves') or contains("label", 'plant')""")
def positive(spark, d):
    return det.positive_labels(detections(spark, d)).select("image_name", "det_id", "label")


@query("ras16_crop_boxes", f"""with {v.PIXELS}, b as (select concat('m', l_suppkey) image_name,
    {DET_ID} det_id, l_orderkey, (l_partkey % 15)::int x0, (l_orderkey % 12)::int y0 from lineitem),
  p as (select b.*, y - y0 ty, x - x0 tx, c, v from b join px on px.image_name = b.image_name
    and y between y0 and y0 + 4 and x between x0 and x0 + 5)
  select image_name, det_id, l_orderkey, 5 height, 6 width, sum(v)::bigint total,
    sum(v * (((ty * 6 + tx) * 3 + c) % 101 + 1))::bigint weighted from p group by image_name, det_id, l_orderkey, x0, y0""")
def crop_boxes(spark, d):
    x0, y0 = (F.col("l_partkey") % 15).cast("int"), (F.col("l_orderkey") % 12).cast("int")
    boxes = v.table(spark, d, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("image_name"),
        det_id(), "l_orderkey",
        x0.alias("x0"), y0.alias("y0"), (x0 + 6).alias("x1"), (y0 + 5).alias("y1"))
    return image_sums(det.crop_boxes(images(spark, d), boxes), ["image_name", "det_id", "l_orderkey", "height", "width"])


def quadrants():
    def find(pixels):
        h, w = pixels.shape[0] // 2, pixels.shape[1] // 2
        words = ("all leaves", "single plant", "sand")
        for y in (0, h):
            for x in (0, w):
                part = pixels[y : y + h, x : x + w].mean((0, 1))
                yield x, y, x + w + 2, y + h + 2, part.max() / 255, words[int(part.argmax())]

    return lambda pixels: list(find(pixels))


@query("ml05_detect", f"""with {v.PIXELS}, q as (select *, (y // {H // 2}) * 2 + x // {W // 2} det_id from px),
  m as (select image_name, det_id, c, avg(v) mean from q group by all),
  b as (select image_name, det_id, (det_id // 2) * {H // 2} y0, (det_id % 2) * {W // 2} x0,
    case arg_max(c, mean - c * 1e-9) when 0 then 'all leaves' when 1 then 'single plant' else 'sand' end "label" from m group by 1, 2),
  p as (select b.*, y - y0 ty, x - x0 tx, c, v from b join px on px.image_name = b.image_name
    and y >= y0 and y < y0 + {H // 2 + 2} and x >= x0 and x < x0 + {W // 2 + 2} where "label" <> 'sand')
  select image_name, det_id, "label", {H // 2 + 2} height, {W // 2 + 2} width, sum(v)::bigint total,
    sum(v * (((ty * {W // 2 + 2} + tx) * 3 + c) % 101 + 1))::bigint weighted from p group by image_name, det_id, "label" """)
def detect(spark, d):
    out = det.detect(images(spark, d), quadrants)
    return image_sums(out, ["image_name", "det_id", "label", "height", "width"])


# --------------------------------------------------------------------------- wide and array forms


def write_bitmaps(spark, d, path):
    """The images as uncompressed bitmap files; the tasks write them into the shared folder."""
    import struct
    from pathlib import Path

    def write(batches):
        Path(path).mkdir(parents=True, exist_ok=True)
        for pdf in batches:
            for r in pdf.itertuples():
                rows = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[::-1]
                body = np.pad(rows.reshape(r.height, -1), ((0, 0), (0, -r.width * 3 % 4))).tobytes()
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, r.width, r.height, 1, 24, 0,
                                   len(body), 2835, 2835, 0, 0)
                (Path(path) / f"{r.image_name}.bmp").write_bytes(head + body)
            yield pdf[["image_name"]]

    return images(spark, d).mapInPandas(write, "image_name string").count()


@query("src02_scan_image_dir", f"""with {v.PIXELS} select image_name || '.bmp' image_name, {H} height, {W} width,
  sum(v)::bigint total, sum(v * (((y * {W} + x) * 3 + c) % 101 + 1))::bigint weighted from px group by 1""")
def scan_image_dir(spark, d):
    path = new_path(spark, "bitmaps").removeprefix("file:")
    write_bitmaps(spark, d, path)
    return image_sums(readers.scan_image_dir(spark, path), ["image_name", "height", "width"])


KINDS = [("click", {"w": b"1"}), ("error", {"w": b"22"}), ("view", {"w": b"333"})]


@query("src11_from_records", """select event_id, n from events join (values ('click', 1), ('error', 2), ('view', 3)) k(event_type, n)
  using (event_type)""")
def from_records(spark, d):
    kinds = readers.from_records(spark, KINDS, "event_type string, detail map<string, binary>")
    events = v.table(spark, d, "events").select("event_id", "event_type")
    return events.join(kinds, "event_type").select("event_id", F.length(F.col("detail")["w"]).alias("n"))


RADIUS1 = LONG + f""", src as (select image_name || '/' || mask_type image_name, y, x, v from long),
  {shifted("e1", "src", "min", 1)}, {shifted("op", "e1", "max", 0)}, {shifted("d1", "src", "max", 0)}, {shifted("cl", "d1", "min", 1)},
  {shifted("d2", "op", "max", 0)}, {shifted("oc", "d2", "min", 1)}
  select split_part(image_name, '/', 1) image_name, split_part(image_name, '/', 2) mask_type, 1 iteration,
    round(avg(op.v), 6) opening_mean, round(avg(cl.v), 6) closing_mean, round(avg(oc.v), 6) opening_closing_mean
  from op join cl using (image_name, y, x) join oc using (image_name, y, x) group by op.image_name, 1, 2"""


@query("ras10_morph_profile_radius1", RADIUS1)
def morph_radius1(spark, d):
    out = raster.morph_profile(wide_masks(spark, d), maximum=1, step=1)
    means = ("opening_mean", "closing_mean", "opening_closing_mean")
    return out.select("image_name", "mask_type", "iteration", *[F.round(c, 6).alias(c) for c in means])


@query("ras10_morph_profile_arrays", RADIUS1)
def morph_arrays(spark, d):
    out = raster.morph_profile_arrays(wide_masks(spark, d), maximum=1, step=1)
    long = out.unpivot(["image_name"], [c for c in out.columns if c != "image_name"], "mask_type", "stats")
    means = ("opening_mean", "closing_mean", "opening_closing_mean")
    return long.select("image_name", F.replace("mask_type", F.lit("_stats"), F.lit("")).alias("mask_type"), F.inline("stats")).select(
        "image_name", "mask_type", "iteration", *[F.round(c, 6).alias(c) for c in means])


@query("ras13_class_mask_columns", LONG + """ select s.image_name, sum(v) filter (where mask_type = 'leaf_mask')::bigint leaf,
  sum(v) filter (where mask_type = 'rock_mask')::bigint rock, 0 wood from long s group by 1""")
def class_columns(spark, d):
    label = F.regexp_replace("mask_type", "_mask", "")
    inst = long_masks(spark, d).where(label.isin("leaf", "rock")).withColumn("label", F.concat(F.lit("all "), label))
    wide = raster.class_mask_columns(
        raster.class_mask_merge(inst), images(spark, d).select("image_name", "height", "width"))
    out = wide.select("image_name", "leaf_mask", "rock_mask", "wood_mask")
    for c in ("leaf", "rock", "wood"):
        out = raster.mask_stats(out, f"{c}_mask").withColumnRenamed("covered", c).drop("total", "mean")
    return out


@query("ras16_detection_arrays", f"""with {DET}, k as (select * from det where contains("label", 'leaves') or contains("label", 'plant'))
  select image_name, count(*)::int n, string_agg("label", ',' order by score desc, det_id) labels,
    string_agg(x0 || ' ' || y0 || ' ' || x1 || ' ' || y1, ',' order by score desc, det_id) boxes from k group by 1""")
def detection_arrays(spark, d):
    rows = det.positive_labels(detections(spark, d)).withColumn("data", F.lit(None).cast("binary"))
    out = det.detection_arrays(rows)
    boxes = F.transform("boxes", lambda b: F.array_join(b.cast("array<string>"), " "))
    return out.select("image_name", F.size("scores").alias("n"), F.array_join("text_labels", ",").alias("labels"),
                      F.array_join(boxes, ",").alias("boxes"))


@query("ras12_filter_by_mask_grids", OR3 + f""", {tiled("merged", 2).replace("tiled as", "t2 as")}, {tiled("merged", 3).replace("tiled as", "t3 as")},
  cov as (select image_name, '2x2' grid, tile, avg(v) pct from t2 group by all union all
    select image_name, '3x3', tile, avg(v) from t3 group by all),
  emb as (select concat('m', vec_id // 18) image_name, case when vec_id % 2 = 0 then '2x2' else '3x3' end grid, (vec_id % 18 // 2)::int tile, vec_id from embeddings)
  select image_name, grid, tile, vec_id, round(pct, 6) pct_covered from emb join cov using (image_name, grid, tile)""")
def filter_by_mask_grids(spark, d):
    e = v.table(spark, d, "embeddings").select(
        F.concat(F.lit("m"), F.floor(F.col("vec_id") / 18).cast("string")).alias("image_name"),
        F.when(F.col("vec_id") % 2 == 0, "2x2").otherwise("3x3").alias("grid"),
        F.floor(F.col("vec_id") % 18 / 2).cast("int").alias("tile"), "vec_id")
    path = new_path(spark, "filtered")
    writers.write_bucketed_dirs(mask_plans.filter_by_mask_grids(e, wide_masks(spark, d), (2, 3)), path, "grid")
    return readers.scan_parquet(spark, path).withColumn("pct_covered", F.round("pct_covered", 6))


@query("ras16_detection_chunks", f"""with {DET}, k as (select * from det where contains("label", 'leaves') or contains("label", 'plant')),
  n as (select *, (row_number() over (partition by image_name order by score desc, det_id, x0, y0, x1, y1) - 1) // 2 chunk from k)
  select image_name, chunk, string_agg("label", ',' order by score desc, det_id) labels,
    string_agg(x0 || ' ' || y0 || ' ' || x1 || ' ' || y1, ',' order by score desc, det_id) boxes from n group by 1, 2""")
def detection_chunks(spark, d):
    rows = det.positive_labels(detections(spark, d)).withColumn("data", F.lit(None).cast("binary"))
    out = det.detection_chunks(rows, size=2)
    boxes = F.transform("boxes", lambda b: F.array_join(b.cast("array<string>"), " "))
    return out.select("image_name", "chunk", F.array_join("text_labels", ",").alias("labels"), F.array_join(boxes, ",").alias("boxes"))


@query("ras10_snk03_profile_masks", RADIUS1)
def profile_masks(spark, d):
    """The job over buckets: a second call finds nothing to do, what it wrote is read back."""
    path = new_path(spark, "profiles")
    run = [morphology.profile_masks(wide_masks(spark, d), path, buckets=4, maximum=1, step=1) for _ in range(2)]
    assert run == [[0, 1, 2, 3], []]
    out = spark.read.parquet(path).drop("sample_id")
    long = out.unpivot(["image_name"], [c for c in out.columns if c != "image_name"], "mask_type", "stats")
    means = ("opening_mean", "closing_mean", "opening_closing_mean")
    return long.select("image_name", F.replace("mask_type", F.lit("_stats"), F.lit("")).alias("mask_type"), F.inline("stats")).select(
        "image_name", "mask_type", "iteration", *[F.round(c, 6).alias(c) for c in means])


def ingest_inputs(spark, d):
    """The images as files and a metadata file in which names repeat and some have no image."""
    line = v.table(spark, d, "lineitem").where("l_suppkey % 3 > 0")
    name = F.concat(F.lit("m"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("string"), F.lit(".bmp"))
    meta = line.select(name.alias("image_name"), F.col("l_partkey").cast("int").alias("species_id"), F.col("l_returnflag").alias("organ"))
    folder, table = new_path(spark, "bitmaps").removeprefix("file:"), new_path(spark, "meta")
    write_bitmaps(spark, d, folder)
    meta.write.csv(table, header=True, sep=";")
    return folder, table, "image_name string, species_id int, organ string"


INGEST_META = """meta as (select 'm' || (l_suppkey + l_linenumber) || '.bmp' image_name, l_partkey::int species_id, l_returnflag organ
  from lineitem where l_suppkey % 3 > 0), file as (select 'm' || s_suppkey || '.bmp' image_name from supplier)"""


@query("src01_jon01_ingest_folder", f"""with {INGEST_META}, pick as (select * from meta qualify row_number() over
  (partition by image_name order by species_id, organ) = 1)
  select image_name, '/' || image_name path, species_id, organ, 54 + {H} * ({W} * 3 + (-{W} * 3) % 4 + 4 * ((({W} * 3) % 4) > 0)::int) bytes
  from file join pick using (image_name)""")
def ingest_folder(spark, d):
    folder, table, schema = ingest_inputs(spark, d)
    out = ingest.ingest_folder(spark, folder, table, schema, new_path(spark, "images"), "*.bmp", base=folder)
    return out.select("image_name", "path", "species_id", "organ", F.length("data").alias("bytes"))


@query("src01_jon01_ingest_report", f"""with {INGEST_META}, m as (select image_name, count(*) n from meta group by 1)
  select count(f.image_name) files, count(f.image_name) "names", count(*) filter (where n > 0 and f.image_name is not null) with_metadata,
    count(*) filter (where n is null) without_metadata, coalesce(sum(n), 0)::bigint metadata_rows,
    coalesce(sum(n - 1), 0)::bigint repeated_rows, count(*) filter (where f.image_name is null) without_file
  from file f full join m using (image_name)""")
def ingest_report(spark, d):
    folder, table, schema = ingest_inputs(spark, d)
    files = readers.image_table(readers.scan_binary_dir(spark, folder, "*.bmp"))
    return ingest.ingest_report(files, readers.scan_metadata_csv(spark, table, schema))
