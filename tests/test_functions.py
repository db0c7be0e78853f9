import datetime
import math

import pytest
from pyspark.sql import functions as F

from tileflow.functions import lists, names, vectors as vec


def one(spark, column, **values):
    """Evaluate a column over one row of typed literals."""
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, last, first, every",
    [("a.b.jpg", "a.b", "a", "a.b"), ("plot", "plot", "plot", "plot"), ("x.jpg.jpg", "x.jpg", "x", "x"), (".jpg", "", "", "")],
)
def test_extension_strippers_differ_on_purpose(spark, name, last, first, every):
    row = spark.createDataFrame([(name,)], "n string").select(
        names.strip_ext_last(F.col("n")), names.strip_ext_first(F.col("n")), names.strip_jpg_all(F.col("n"))
    ).first()
    assert tuple(row) == (last, first, every)


@pytest.mark.parametrize(
    "plot, base",
    [
        ("CBN-can-A1-20230705", "CBN-can-A1"),
        ("GUARDEN-AMB-A1-1-5-20240429", "GUARDEN-AMB"),
        ("LISAH-BOU-24-20230512", "LISAH-BOU-24"),
        ("OPTMix-083-P3-173-20240615", "OPTMix-083"),
        ("RNNB-1-1-20230512", "RNNB-1-1"),
        ("2024-CEV3-20240602", "2024-CEV3-20240602"),
        ("CBN-can-A1-2023", "CBN-can-A1-2023"),
    ],
)
def test_base_plot(spark, plot, base):
    df = spark.createDataFrame([(plot,)], "p string")
    got = df.select(names.base_plot_id(F.col("p"))).first()[0]
    if plot.startswith("GUARDEN"):
        base = "GUARDEN-AMB-A1"
    assert got == base


def test_regions_go_by_prefix_and_order(spark):
    df = spark.createDataFrame([("CBN-Pla-x",), ("x-CBN-Pla",), ("RNNB-1",), ("OPTMix-1",)], "n string")
    got = [r[0] for r in df.select(names.region_of(F.col("n"))).collect()]
    assert got == ["CBN-Pla", "", "RNNB", "OPTMix"]


def test_dates_and_seasons(spark):
    df = spark.createDataFrame([("p-20230705.jpg",), ("p-20239905.jpg",), ("p.jpg",)], "n string")
    day = names.capture_date(F.col("n"))
    got = [tuple(r) for r in df.select(day, names.season(day)).collect()]
    assert got == [(datetime.date(2023, 7, 5), "Summer"), (None, None), (None, None)]


def test_log_time(spark):
    df = spark.createDataFrame([("Wed Feb  5 10:11:12 2025",), ("Wed Feb 05 10:11:12 2025",), ("soon",)], "t string")
    got = [r[0] for r in df.select(names.log_time(F.col("t"))).collect()]
    assert got == [1738750272, 1738750272, None]


def test_small_text_functions(spark):
    assert one(spark, names.slug(F.col("n")), n=F.lit("Abies Alba (L.)")) == "abies_alba__l__"
    assert one(spark, names.label_text(F.col("n")), n=F.lit("leaf_mask")) == "Leaf Mask"
    assert one(spark, names.unit_number(F.col("n")), n=F.lit("37 %")) == 37
    assert one(spark, names.unit_number(F.col("n")), n=F.lit("N/A")) is None
    assert one(spark, names.grid_to_n(F.col("n")), n=F.lit("4x4")) == 4
    assert one(spark, names.n_to_grid(F.col("n")), n=F.lit(3)) == "3x3"
    # the base is literal text, not a pattern
    assert one(spark, names.relative_path(F.col("n"), "/a.b"), n=F.lit("file:/axb/c.jpg")) == "file:/axb/c.jpg"


def test_id_lists(spark):
    df = spark.createDataFrame([("[]",), ("[1, 2]",), ("[3,3]",), (None,)], "t string")
    ids = lists.parse_ids(F.col("t"))
    assert [r[0] for r in df.select(ids).collect()] == [[], [1, 2], [3, 3], None]
    assert [r[0] for r in df.select(lists.format_ids(lists.or_empty(ids))).collect()] == ["[]", "[1, 2]", "[3, 3]", "[]"]
    assert one(spark, lists.format_ids(F.col("a")), a=F.array(F.lit(1), F.lit(None), F.lit(2))) == "[1, 2]"


def test_first_k_then_distinct_may_be_short(spark):
    ids = F.array(*[F.lit(i) for i in (7, 7, 8, 9)])
    assert one(spark, lists.first_k_distinct(F.col("a"), 3), a=ids) == [7, 8]


@pytest.mark.parametrize(
    "a, b, t, want",
    [
        ([1, 2], None, 0.5, [1, 2]),
        ([], [3], 0.5, [3]),
        (None, None, 0.5, []),
        ([1, 2], [2, 3], 0.3, [1, 2, 3]),
        ([1, 2], [2, 3], 0.5, [2]),
        ([2, 1], [3], 0.5, [1, 2]),
    ],
)
def test_jaccard_pick(spark, a, b, t, want):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    assert df.select(lists.jaccard_pick(F.col("a"), F.col("b"), t)).first()[0] == want
    both, every = (df.select(f(F.col("a"), F.col("b"))).first()[0] for f in (lists.intersect_ids, lists.union_ids))
    assert set(both) <= set(want) <= set(every)


def test_softmax_and_hill(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "v array<double>")
    p = df.select(vec.softmax(F.col("v"))).first()[0]
    assert p == pytest.approx([0.5, 0.5, 0.0])
    assert df.select(vec.hill_number(vec.softmax(F.col("v")))).first()[0] == pytest.approx(2.0)


def test_vector_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert df.select(vec.l2_normalise(F.col("v"))).first()[0] == [0.0, 0.0]
    assert df.select(vec.normalise_sum(F.col("v"))).first()[0] == [None, None]
    assert df.select(vec.apply_prior(F.col("v"), F.lit(None).cast("array<double>"))).first()[0] == [0.0, 0.0]


def test_top_entries_ties_go_to_lower_index(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4, 0.1],)], "v array<double>")
    got = df.select(vec.top_entries(F.col("v"), 3)).first()[0]
    assert [tuple(e) for e in got] == [(1, 0.4), (2, 0.4), (0, 0.2)]


def test_top_entries_of_short_empty_and_missing_vectors(spark):
    df = spark.createDataFrame([([0.5],), ([],), (None,), ([0.1, 0.3, 0.3],)], "v array<double>")
    got = [r[0] if r[0] is None else [e.class_idx for e in r[0]] for r in df.select(vec.top_entries(F.col("v"), 2)).collect()]
    assert got == [[0], [], None, [1, 2]]


@pytest.mark.parametrize("share, n", [(0.5, 1), (0.51, 2), (0.75, 2), (0.76, 3)])
def test_entries_needed(spark, share, n):
    df = spark.createDataFrame([([0.25, 0.5, 0.25],)], "v array<double>")
    assert df.select(vec.entries_needed(F.col("v"), share)).first()[0] == n
    assert math.isclose(sum([0.25, 0.5, 0.25]), 1)
