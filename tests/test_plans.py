"""Ingest, morphology over buckets, and lists in bounded chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileflow.operators import counting, detections, numbering, raster, scoring
from tileflow.plans import ingest, morphology


def test_ingest_folder(spark, tmp_path):
    folder = tmp_path / "pics"
    (folder / "5").mkdir(parents=True)
    for name in ("5/a.jpg", "b.jpg", "c.jpg", "5/note.txt"):
        (folder / name).write_bytes(name.encode())
    (tmp_path / "m.csv").write_text("image_name;species_id;path\na.jpg;7;old\na.jpg;3;new\nb.jpg;;x\nz.jpg;1;y\n")
    schema = "image_name string, species_id int, path string"
    out = ingest.ingest_folder(spark, str(folder), str(tmp_path / "m.csv"), schema, str(tmp_path / "out"), base=str(tmp_path))
    got = {r.image_name: (r.path, bytes(r.data), r.species_id, r.meta_path) for r in out.collect()}
    assert got == {"a.jpg": ("/pics/5/a.jpg", b"5/a.jpg", 3, "new"), "b.jpg": ("/pics/b.jpg", b"b.jpg", None, "x")}

    files = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "image_name string")
    meta = spark.createDataFrame([("a",), ("b",), ("b",), ("z",), (None,)], "image_name string")
    report = ingest.ingest_report(files, meta).first()
    assert report.asDict() == {"files": 5, "names": 3, "with_metadata": 3, "without_metadata": 2, "metadata_rows": 5,
                               "repeated_rows": 1, "without_file": 1}
    nothing = ingest.ingest_report(files.where("false"), meta.where("false")).first()
    assert set(nothing.asDict().values()) == {0}


def test_profiles_go_on_where_they_stopped(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"m{i}" if i else None, 9, raster.encode_mask(rng.random((12, 9)) < 0.6) if i != 3 else None) for i in range(12)]
    masks = spark.createDataFrame(rows, "image_name string, sample_id int, leaf_mask binary")
    path = str(tmp_path / "profiles")
    assert morphology.profile_masks(masks, path, buckets=3, maximum=4, step=2) == [0, 1, 2]
    assert morphology.profile_masks(masks, path, buckets=5, maximum=4, step=2, tasks=2) == [3, 4]
    whole = str(tmp_path / "whole")
    morphology.profile_masks(masks, whole, buckets=3, maximum=4, step=2)
    got = {r.image_name: r.leaf_mask_stats for r in spark.read.parquet(whole).collect()}
    want = {r.image_name: r.leaf_mask_stats for r in raster.morph_profile_arrays(masks.drop("sample_id"), maximum=4, step=2).collect()}
    assert got == want and len(got) == 12 and got["m3"] is None


def chunks_of(weights, size, most):
    """The chunk of each row of a key, one after the other."""
    out, start = [], 0
    for block in range(0, len(weights), size):
        part = weights[block : block + size]
        stretch = [sum(part[:i]) // most for i in range(len(part))]
        ranks = {s: i for i, s in enumerate(sorted(set(stretch)))}
        out += [start + ranks[s] for s in stretch]
        start = out[-1] + 1
    return out


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_chunks_are_bounded_and_in_order(spark, size):
    rng = np.random.default_rng(5)
    keys = ["hot"] * 300 + [None] * 40 + [f"k{i}" for i in rng.integers(0, 30, 300)]
    rows = [(k, i, int(w)) for i, (k, w) in enumerate(zip(keys, rng.integers(0, 60, len(keys))))]
    df = spark.createDataFrame(rows, "key string, id bigint, bytes bigint").repartition(6)
    got = numbering.bounded_chunks(df, ["key"], ["id"], size, F.col("bytes"), 100)
    assert got.columns == ["key", "id", "bytes", "chunk"]
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.id):
        found.setdefault(r.key, []).append((r.bytes, r.chunk))
    assert sum(map(len, found.values())) == len(rows)
    for pairs in found.values():
        assert [c for _, c in pairs] == chunks_of([b for b, _ in pairs], size, 100)
    plain = numbering.bounded_chunks(df, ["key"], ["id"], size).groupBy("key", "chunk").count().collect()
    assert all(r["count"] <= size for r in plain)


def test_lists_in_chunks(spark):
    rows = [("a", i % 25) for i in range(100)] + [("b", None), (None, 4), (None, 4)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = {(r.g, r.chunk): r["items"] for r in counting.group_list_chunks(df, "g", "x", size=10).collect()}
    assert got == {("a", 0): list(range(10)), ("a", 1): list(range(10, 20)), ("a", 2): list(range(20, 25)), (None, 0): [4]}
    all_rows = counting.group_list_chunks(df, "g", "x", distinct=False, size=10).where("g = 'a'").orderBy("chunk").collect()
    assert sum((r["items"] for r in all_rows), []) == sorted(i % 25 for i in range(100))
    assert counting.group_list_chunks(df.where("false"), "g", "x").count() == 0


def test_detections_of_a_crowded_image(spark):
    rows = [("crowd", i, 0.0, 0.0, 1.0, 1.0, (i * 37 % 101) / 101, "leaves", bytes(30)) for i in range(101)]
    rows += [("two", i, 0.0, 0.0, 1.0, 1.0, 0.5, "plant", None) for i in range(2)]
    df = spark.createDataFrame(rows, detections.DETECTION + ", data binary")
    whole = {r.image_name: r for r in detections.detection_arrays(df).collect()}
    parts = detections.detection_chunks(df, size=40, most=300).orderBy("image_name", "chunk").collect()
    assert len(parts) > 10 and all(len(r.scores) <= 10 for r in parts)
    for name in ("crowd", "two"):
        mine = [r for r in parts if r.image_name == name]
        assert [r.chunk for r in mine] == list(range(len(mine)))
        assert sum((r.scores for r in mine), []) == whole[name].scores
        assert sum((r.boxes for r in mine), []) == whole[name].boxes


def test_scorer_gives_floats(spark, tmp_path):
    df = spark.createDataFrame([([0.1, 2.0],)], "v array<double>")
    made = scoring.BatchScorer(inputCol="v", outputCol="o", modelPath="[[1, 0.3], [0.5, 1]]", inputWidth=2, outputType="float")
    made.save(str(tmp_path / "scorer"))
    out = scoring.BatchScorer.load(str(tmp_path / "scorer")).transform(df)
    assert dict(out.dtypes)["o"] == "struct<cls_token:array<float>,logits:array<float>>"
    assert out.first().o.logits == [float(np.float32(x)) for x in (1.1, 2.03)]
    with pytest.raises(ValueError, match="outputType"):
        scoring.BatchScorer(inputCol="v", outputType="int").transform(df)
