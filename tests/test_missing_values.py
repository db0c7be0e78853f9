"""Null keys and values, nan, large integers and repeated rows: nothing is lost, and group sizes change no result."""

import math

import numpy as np
import pytest

from tileflow.operators import clusters, counting, detections, numbering, priors, quantiles, raster, thresholds
from tileflow.plans import submission

BIG = 2**53


@pytest.mark.parametrize("gather", [2, 100_000])
@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,2)"])
def test_threshold_keeps_type_nulls_and_nan_rule(spark, gather, kind):
    values = [(None, BIG + i) for i in range(8)] + [("a", BIG + i) for i in range(7)] + [("a", None), ("b", 5), ("b", 5)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values)], "id int, image_name string, value bigint")
    df = df.selectExpr("id", "image_name", f"cast(value as {kind}) as value")
    if kind == "double":
        df = df.unionByName(df.selectExpr("100 + id", "image_name", "double('nan')").toDF(*df.columns))
    got = thresholds.percentile_threshold_by_image(df, "value", 0.5, gather=gather)
    assert got.columns == ["id", "image_name", "value", "threshold"]
    assert got.schema["threshold"].dataType == df.schema["value"].dataType
    kept = sorted(r["id"] for r in got.collect())
    if kind == "double":  # neighbouring large integers are one double
        rows = {r["id"]: (r["image_name"], r["value"]) for r in df.collect()}
        want = []
        for key in (None, "a", "b"):
            known = sorted(v for k, v in rows.values() if k == key and v is not None and not math.isnan(v))
            limit = known[math.ceil(len(known) / 2) - 1]
            want += [i for i, (k, v) in rows.items() if k == key and v is not None and v <= limit]
        assert kept == sorted(want)
    else:
        assert kept == [0, 1, 2, 3, 8, 9, 10, 11, 16, 17]


@pytest.mark.parametrize("gather", [1, 3, 100_000])
def test_percentiles_of_large_integers(spark, gather):
    df = spark.createDataFrame([(BIG * 4 + i,) for i in (5, 1, 3, 2, 4)], "x bigint")
    row = quantiles.exact_percentiles(df, [], "x", [0.2, 0.4, 0.6, 1.0], gather).first()
    assert [row[f"q{i}"] - BIG * 4 for i in range(4)] == [1, 2, 3, 5]


def test_row_number_of_a_null_key(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a")], "id int, key string")
    got = {r["id"]: r["row_number"] for r in numbering.row_number_by_key(df, ["key"], ["id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def boxes(spark):
    box = lambda name, i, x, size, score: (name, i, float(x), 0.0, float(x + size), float(size), score, "plant")
    rows = []
    for name in ("a", None):
        rows += [box(name, i, 7 * i, 10, 0.9 - i / 100) for i in range(6)]
        rows += [box(name, 50, 500, 0, 0.5)] * 3  # boxes without an area overlap nothing, copies included
        rows += [box(name, 60, 900, 4, 0.4)] * 2
    return spark.createDataFrame(rows, detections.DETECTION)


def test_suppression_does_not_depend_on_the_crowd(spark):
    df = boxes(spark)
    whole = sorted(map(str, detections.detections_nms(df).collect()))
    assert len(whole) == 2 * (6 + 3 + 1)
    for crowd in (1, 2, 5):
        assert sorted(map(str, detections.detections_nms(df, crowd=crowd).collect())) == whole


def test_joint_prior_of_a_null_cluster(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), ("c", [0.0, 0.0])], "cluster string, logits array<double>")
    for joint in (True, False):
        got = {r.cluster: r.prior_probabilities for r in priors.cluster_prior(df, "cluster", "logits", joint).collect()}
        assert set(got) == {None, "c"} and got["c"] == [0.5, 0.5]
        assert np.allclose(sum(got[None]), 1)


def test_centroids_of_a_null_species_and_null_vectors(spark):
    rows = [(1, None, [5.0, 3.0]), (2, None, [1.0, 3.0]), (3, "s", [1.0, 1.0]), (4, "s", None), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, species string, vec array<double>")
    got = {r.species: r.centre for r in clusters.species_centroids(df, "species", "vec", "id", n=1).collect()}
    assert got == {None: [3.0, 3.0], "s": [1.0, 1.0]}


def test_shrinkage_keeps_species_without_a_genus(spark):
    rows = [("f", "g", "s1", 1.0), ("f", None, "s2", 3.0), (None, None, "n", 2.0)]
    df = spark.createDataFrame(rows, "family string, s string, n string, v double")
    got = counting.taxon_shrinkage(df, "n", "s", "family", "v").collect()
    assert {r[0] for r in got} == {"s1", "s2", "n"}
    with_genus = df.where("s is not null")
    assert counting.taxon_shrinkage(with_genus, "n", "s", "family", "v").first()["estimate"] == pytest.approx(1.0)


def test_a_class_without_a_species_is_an_error(spark):
    tiles = spark.createDataFrame([("a.jpg", 0, [0.2, 0.8])], "image_name string, tile int, probabilities array<double>")
    classes = spark.createDataFrame([(0, 7)], "class_idx int, species_id bigint")
    with pytest.raises(Exception, match="no species for class 1"):
        submission.tile_predictions(tiles, classes).collect()


def test_null_masks(spark):
    mask = raster.encode_mask(np.eye(4))
    df = spark.createDataFrame([("a", bytearray(mask)), ("n", None)], "image_name string, mask binary")
    stats = {r.image_name: (r.total, r.covered, r["mean"]) for r in raster.mask_stats(df).collect()}
    assert stats == {"a": (16, 4, 0.25), "n": (None, None, None)}
    assert {r.image_name: r.components for r in raster.connected_components(df).collect()} == {"a": 1, "n": None}
    both = {r.image_name: (r.opened, r.closed) for r in raster.open_close(df, 1).collect()}
    assert both["n"] == (None, None) and not raster.decode_mask(both["a"][0]).any()
    for made in (raster.tile_mask(df, 2), raster.tile_coverage(df, 2), raster.covered_tile_count(df, [2])):
        assert {r.image_name for r in made.collect()} == {"a"}


def test_distance_is_that_of_the_city_block():
    rng = np.random.default_rng(1)
    for shape in ((7, 9), (1, 6), (5, 1)):
        mask = rng.random(shape) < 0.2
        got = raster._distance(mask)
        at = np.argwhere(mask)
        for y, x in np.ndindex(shape):
            want = min((abs(y - a) + abs(x - b) for a, b in at), default=None)
            assert got[y, x] == want if want is not None else got[y, x] > 2**20
