from pyspark.sql import functions as F

from tileflow.operators import records


def test_habitat_sets_and_their_candidates(spark):
    plots = spark.createDataFrame(
        [("a", ["wood", "moor"]), ("b", ["moor", "wood", "moor"]), ("c", []), ("d", None), ("e", [None]), (None, ["dune"])],
        "plot string, habitats array<string>",
    )
    species = spark.createDataFrame(
        [(1, ["moor", "moor"]), (2, ["dune", "wood"]), (3, None), (4, [None])], "species int, habitats array<string>"
    )
    sets, members = records.habitat_sets(plots, "plot", "habitats")
    number = {tuple(r.habitats): r.set_id for r in sets.collect()}
    assert sorted(number.values()) == [0, 1, 2, 3]
    assert set(number) == {(), ("dune",), ("moor", "wood"), (None,)}
    both = number["moor", "wood"]
    assert {(r.plot, r.set_id) for r in members.collect()} == {
        ("a", both), ("b", both), ("c", number[()]), ("d", None), ("e", number[(None,)]), (None, number["dune",])
    }
    found = records.candidates_by_set(sets, species, "species", "habitats")
    assert sorted(tuple(r) for r in found.collect()) == sorted([(both, 1), (both, 2), (number["dune",], 2)])
    pairs = records.candidates_by_habitat(plots, species, "plot", "species", "habitats")
    want = [("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 2)]
    assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)
    assert records.candidates_by_habitat(plots.limit(0), species, "plot", "species", "habitats").count() == 0


def test_measures_of_candidates_without_the_pairs(spark):
    plots = spark.createDataFrame(
        [("a", ["wood"]), ("a", ["moor", "wood"]), ("b", ["moor"]), ("c", ["wood", "moor"]), ("d", ["sea"]), ("e", None), (None, ["moor"])],
        "plot string, habitats array<string>",
    )
    species = spark.createDataFrame([(1, ["moor", "wood"]), (2, ["wood"]), (4, ["moor"])], "species int, habitats array<string>")
    pairs = records.candidates_by_habitat(plots, species, "plot", "species", "habitats")
    want = [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 4), ("c", 1), ("c", 2), ("c", 4), (None, 1), (None, 4)]
    assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)
    measures = [F.count("*").alias("n"), F.sum("species").alias("total")]
    got = records.candidates_by_habitat(plots, species, "plot", "species", "habitats", measures)
    assert {tuple(r) for r in got.collect()} == {("a", 3, 7), ("b", 2, 5), ("c", 3, 7), (None, 2, 5)}
