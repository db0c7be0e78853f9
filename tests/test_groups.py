"""Operators over groups, with one group that holds a third of all rows or more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileflow.operators import clusters, joins, label_lists as ll, numbering, quantiles, thresholds
from tileflow.plans import submission


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    keys = ["hot"] * 700 + [f"k{i}" for i in rng.integers(0, 40, 1300)]
    values = np.round(rng.gamma(2.0, 10.0, 2000), 2)
    values[:300] = 5.0
    rows = [(i, k, float(v)) for i, (k, v) in enumerate(zip(keys, values))] + [(2000, None, 1.0), (2001, None, 2.0), (2002, "hot", None)]
    return spark.createDataFrame(rows, "id bigint, key string, value double").repartition(7), rows


def disc(values, p):
    values = sorted(values)
    return values[max(1, int(np.ceil(round(p * len(values), 9)))) - 1]


@pytest.mark.parametrize("gather", [10, 100, 10_000])
def test_percentiles_of_large_and_small_groups(spark, skewed, gather):
    df, rows = skewed
    points = [0.01, 0.1, 0.5, 0.9, 1.0]
    got = {r["_group"]["key"]: [r[f"q{i}"] for i in range(5)] for r in quantiles.exact_percentiles(df, ["key"], "value", points, gather).collect()}
    for key in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == key and r[2] is not None]
        assert got[key] == [disc(values, p) for p in points]
    values = [r[2] for r in rows if r[2] is not None]
    whole = quantiles.exact_percentiles(df, [], "value", points, gather).first()
    assert [whole[f"q{i}"] for i in range(5)] == [disc(values, p) for p in points]


def test_global_threshold(spark, skewed):
    df, rows = skewed
    limit = disc([r[2] for r in rows if r[2] is not None], 0.2)
    assert thresholds.global_percentile(df, "value", 0.2) == limit
    got = thresholds.global_threshold_topn(df, "value", 0.2, cap=None, by="key", tie="id")
    assert got.count() == sum(r[2] is not None and r[2] <= limit for r in rows)


def test_percentiles_with_extreme_values(spark):
    inf, big = float("inf"), 1.7e308
    values = [-inf] * 3 + [-big, -1.0, 0.0, 5e-324, 1e-323, 1.0, 1.0, 1.0, 2.0, big] + [inf] * 2 + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    points = [i / 15 for i in range(1, 16)]
    row = quantiles.exact_percentiles(df, [], "x", points, gather=2).first()
    assert [row[f"q{i}"] for i in range(15)] == [disc(values[:15], p) for p in points]


@pytest.mark.parametrize("miss", [False, True])
def test_percentiles_by_a_rough_sketch(spark, monkeypatch, miss):
    """A sketch that is off by a hundredth of the rows, and brackets that miss, give the same values."""
    n = 60_000
    x = (F.col("id") * 7919 % n / 3).cast("double")
    df = spark.range(n).repartition(5).select((F.col("id") % 3 == 0).alias("key"), F.when(F.col("id") % 10 == 1, 7.0).otherwise(x).alias("x"))
    if miss:
        made = quantiles._brackets
        monkeypatch.setattr(quantiles, "_brackets", lambda *a: made(*a).withColumn("high", F.col("low")))
    points = [0.001, 0.3, 0.5, 0.999]
    got = {r["_group"]["key"]: [r[f"q{i}"] for i in range(4)] for r in quantiles.exact_percentiles(df, ["key"], "x", points, 100, 100).collect()}
    values = {k: [7.0 if i % 10 == 1 else i * 7919 % n / 3 for i in range(n) if (i % 3 == 0) == k] for k in (False, True)}
    assert got == {k: [disc(v, p) for p in points] for k, v in values.items()}


@pytest.mark.parametrize("gather", [50, 10_000])
def test_threshold_by_group(spark, skewed, gather):
    df, rows = skewed
    got = {r["id"] for r in thresholds.percentile_threshold_by_image(df, "value", 0.25, "key", gather=gather).collect()}
    limits = {k: disc([r[2] for r in rows if r[1] == k and r[2] is not None], 0.25) for k in {r[1] for r in rows}}
    assert got == {r[0] for r in rows if r[2] is not None and r[2] <= limits[r[1]]}


def test_dense_row_id(spark, skewed):
    df, rows = skewed
    got = numbering.dense_row_id(df, ["value", "id"], "n").collect()
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert {r["id"]: r["n"] for r in got} == {r[0]: i for i, r in enumerate(order)}


def test_row_number_by_key(spark, skewed):
    df, rows = skewed
    got = {r["id"]: r["row_number"] for r in numbering.row_number_by_key(df, ["key"], ["id"]).collect()}
    seen = {}
    for i, key, _ in rows:
        seen[key] = seen.get(key, 0) + 1
        assert got[i] == seen[key]


def test_batches_cover_everything(spark, skewed):
    df, rows = skewed
    sizes = [r["n"] for r in numbering.fixed_batches(df, ["id"], 100).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert sizes == [100] * 20 + [3]


def test_stratified_sample_size(spark, skewed):
    df, rows = skewed
    got = {r["key"]: r["n"] for r in numbering.stratified_sample(df, "key", 5).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert max(got.values()) == 5 and got["hot"] == 5 and got[None] == 2


def test_union_by_frequency_breaks_ties_by_first_seen(spark):
    rows = [("g", 1, 0, 9), ("g", 1, 1, 8), ("g", 2, 0, 8), ("g", 2, 1, 7), ("g", 3, 0, 7), ("g", 3, 1, 5), ("h", 1, 0, 4)]
    df = spark.createDataFrame(rows, "grp string, row int, pos int, item bigint")
    got = ll.list_union_by_freq(df, "grp", "item", ["row", "pos"])
    assert sorted((r.grp, r["rank"], r.item, r.votes) for r in got.collect()) == [
        ("g", 1, 8, 2), ("g", 2, 7, 2), ("g", 3, 9, 1), ("g", 4, 5, 1), ("h", 1, 4, 1)]
    top = ll.list_union_by_freq(df, "grp", "item", ["row", "pos"], k=2)
    assert sorted((r.grp, r.item) for r in top.collect()) == [("g", 7), ("g", 8), ("h", 4)]


def test_visits_share_their_species(spark):
    df = spark.createDataFrame(
        [("RNNB-1-1-20230512", [1, 2]), ("RNNB-1-1-20240512", [2, 3]), ("other", [4])], "quadrat_id string, species_ids array<bigint>")
    got = {r.quadrat_id: r.species_ids for r in submission.aggregate_visits(df).collect()}
    assert got == {"RNNB-1-1-20230512": [2, 1, 3], "RNNB-1-1-20240512": [2, 1, 3], "other": [4]}
    got = {r.quadrat_id: r.species_ids for r in submission.aggregate_visits(df, k=2).collect()}
    assert got["RNNB-1-1-20230512"] == [2, 1]


def test_allowed_elements_keep_order_duplicates_and_empty_rows(spark):
    df = spark.createDataFrame([("a", [3, 1, 3, 2]), ("b", [9]), ("c", []), ("d", None)], "quadrat_id string, species_ids array<bigint>")
    allowed = spark.createDataFrame([(3,), (2,), (2,)], "species_id int")
    got = {r.quadrat_id: r.species_ids for r in joins.keep_allowed_elements(df, allowed).collect()}
    assert got == {"a": [3, 3, 2], "b": [], "c": [], "d": []}


def test_indicator(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(map(tuple, joins.join_indicator_diff(a, b, ["id"]).collect())) == [(1, "left_only"), (2, "both"), (3, "right_only")]
    assert joins.join_indicator_diff(a, b, ["id"], only_diff=True).count() == 2


def test_lookup_with_dict(spark):
    df = spark.createDataFrame([("x",), ("y",)], "k string")
    got = {r.k: r.n for r in joins.map_lookup_default(df, {"x": 3}, "k", "n").collect()}
    assert got == {"x": 3, "y": 0}


@pytest.mark.parametrize("held_bytes", [64 << 20, 1000, 0])
def test_species_centroids_match_a_plain_loop(spark, held_bytes):
    """All species in tasks, the hot one in rounds, all in rounds; one species has no name, one repeats a vector."""
    rng = np.random.default_rng(0)
    rows = [(i, "hot" if i < 60 else f"s{i % 3}", rng.normal(size=3).tolist()) for i in range(100)] + [(100, "single", [1.0, 2.0, 3.0])]
    rows += [(200 + i, None, rng.normal(size=3).tolist()) for i in range(7)] + [(300 + i, "same", [1.0, 0.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, species string, vec array<double>").repartition(5)
    got = clusters.species_centroids(df, "species", "vec", "id", n=3, iterations=20, held_bytes=held_bytes)
    found = {}
    for r in got.collect():
        found.setdefault(r.species, {})[r.centroid] = r.centre
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    for species in {r[1] for r in rows}:
        members = sorted((hashes[i], i, v) for i, s, v in rows if s == species)
        x = np.array([m[2] for m in members])
        centres = x[:3].copy()
        for _ in range(20):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        assert sorted(found[species]) == list(range(len(centres)))
        for c, centre in enumerate(centres):
            assert found[species][c] == pytest.approx(centre.tolist())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_leave_the_centres_as_they_are(spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 3000)] + rng.normal(scale=spread, size=(3000, 5))
    x[5::7] = x[5]
    centres = x[:8].copy()
    for _ in range(30):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(8)])
    assert np.allclose(clusters._lloyd(x, 8, 30), centres, atol=1e-9)


def test_row_numbers_write_their_rows_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(numbering, "settle", lambda df, label="table", real=numbering.settle: written.append(label) or real(df, label))
    df = spark.createDataFrame([(k, i) for i in range(40) for k in ("a", "b", None)], "key string, i int").repartition(4)
    rows = numbering.row_number_by_key(df, ["key"], ["i"]).collect()
    assert {(r.key, r.row_number) for r in rows} == {(k, i + 1) for i in range(40) for k in ("a", "b", None)}
    assert all(r.row_number == r.i + 1 for r in rows) and written == ["rows"]
