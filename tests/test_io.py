import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileflow.functions import lists
from tileflow.operators import records, scoring
from tileflow.operators.shaping import hash_bucket
from tileflow.sources import readers, tables, writers
from tileflow.streaming import feeds


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_binary_and_image_folders(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    body = np.pad(pixels[::-1].reshape(2, 9), ((0, 0), (0, 3))).tobytes()
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 3, 2, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    (folder / "x.bmp").write_bytes(head + body)
    (folder / "bad.bmp").write_bytes(b"nothing")
    (folder / "note.txt").write_text("no image")
    files = readers.image_table(readers.scan_binary_dir(spark, str(tmp_path / "a"), "*.bmp"), str(tmp_path / "a"))
    assert {r.image_name: r.path for r in files.collect()} == {"x.bmp": "/b/x.bmp", "bad.bmp": "/b/bad.bmp"}
    assert readers.scan_binary_dir(spark, str(tmp_path / "a"), "*.bmp", recursive=False).count() == 0
    (folder / "note.txt").unlink()
    got = {r.image_name: r for r in readers.scan_image_dir(spark, str(folder), drop_invalid=False).collect()}
    assert (got["x.bmp"].height, got["x.bmp"].width, got["x.bmp"].channels) == (2, 3, 3)
    assert bytes(got["x.bmp"].data) == pixels.tobytes()
    assert got["bad.bmp"].height == -1 and got["bad.bmp"].data is None
    assert readers.scan_image_dir(spark, str(folder)).count() == 1


@pytest.mark.parametrize(
    "style, sep, want",
    [
        ("quoted", ",", '"quadrat_id","species_ids"\n"a","[1, 2]"\n"b","[]"\n'),
        ("plain", ";", "quadrat_id;species_ids\na;[1, 2]\nb;[]\n"),
    ],
)
def test_prediction_files(spark, tmp_path, style, sep, want):
    df = spark.createDataFrame([("b", []), ("a", [1, 2])], "quadrat_id string, species_ids array<bigint>")
    path = tmp_path / style
    writers.write_predictions_csv(writers.prediction_text(df), str(path), style, single_file=True)
    assert text_of(path) == want
    back = readers.scan_predictions_csv(spark, str(path), sep)
    ids = {r.quadrat_id: r.ids for r in back.select("quadrat_id", lists.parse_ids(F.col("species_ids")).alias("ids")).collect()}
    assert ids == {"a": [1, 2], "b": []}


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_name;species_id;altitude\nx.jpg;3;1.5\ny.jpg;4;\n")
    df = readers.scan_metadata_csv(spark, str(tmp_path / "m.csv"), "image_name string, species_id int, altitude double")
    assert sorted(map(tuple, df.collect())) == [("x.jpg", 3, 1.5), ("y.jpg", 4, None)]


def test_country_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Abies": {"FR": 3, "ES": 1}}, indent=1))
    got = sorted(map(tuple, readers.scan_country_json(spark, str(tmp_path)).collect()))
    assert got == [("Abies", "ES", 1), ("Abies", "FR", 3)]


def test_class_index_keeps_line_order(spark, tmp_path):
    (tmp_path / "c.txt").write_text("30\n10\n20\n")
    assert sorted(map(tuple, readers.scan_class_index(spark, str(tmp_path / "c.txt")).collect())) == [(0, 30), (1, 10), (2, 20)]


def test_telemetry_shapes(spark, tmp_path):
    def doc(info):
        return json.dumps({"nvidia_smi_log": {"timestamp": "Wed Feb 05 10:11:12 2025", "gpu": {
            "product_name": "G", "utilization": {"gpu_util": "3 %", "memory_util": "4 %"}, "processes": {"process_info": info}}}})

    one = {"pid": "1", "used_memory": "10 MiB"}
    (tmp_path / "log.ndjson").write_text("\n".join([doc(one), doc([one, {"pid": "2", "used_memory": "N/A"}]), doc(json.dumps(one))]))
    rows = readers.process_rows(readers.scan_telemetry(spark, str(tmp_path)))
    assert sorted((r.pid, r.used_memory_mb or 0) for r in rows.collect()) == [("1", 10), ("1", 10), ("1", 10), ("2", 0)]


def test_buckets(spark, tmp_path):
    import zlib

    df = spark.createDataFrame([(f"x{i}.jpg",) for i in range(50)], "image_name string")
    got = {r.image_name: r.b for r in df.select("image_name", hash_bucket(F.col("image_name"), 7).alias("b")).collect()}
    assert got == {k: zlib.crc32(k.encode()) % 7 for k in got}
    out = str(tmp_path / "out")
    bucketed = df.withColumn("sample_id", hash_bucket(F.col("image_name"), 7))
    writers.write_bucketed_dirs(bucketed, out, "sample_id")
    writers.write_bucketed_dirs(bucketed.where("sample_id = 3"), out, "sample_id")  # others stay
    assert readers.scan_parquet(spark, out).count() == 50
    assert "sample_id" not in readers.scan_parquet_recursive(spark, out).columns


def test_key_stays_in_one_file(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    writers.write_parquet_by_key(df, str(tmp_path / "one"), 4, "k")
    per_key = spark.read.parquet(str(tmp_path / "one")).withColumn("f", F.input_file_name()).groupBy("k").agg(F.count_distinct("f").alias("n"))
    assert per_key.agg(F.max("n")).first()[0] == 1
    writers.write_parquet_by_key(df, str(tmp_path / "salted"), 4, "k", salts=2)
    per_key = spark.read.parquet(str(tmp_path / "salted")).withColumn("f", F.input_file_name()).groupBy("k").agg(F.count_distinct("f").alias("n"))
    assert per_key.agg(F.max("n")).first()[0] <= 2


def test_pending_buckets_resume_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "buckets")
    df = spark.range(100).withColumn("sample_id", (F.col("id") % 5).cast("int"))
    seen = []

    def make(rows):
        seen.append(sorted(r.sample_id for r in rows.select("sample_id").distinct().collect()))
        return rows.where("sample_id <> 4")  # a bucket may come out empty

    assert writers.write_pending_buckets(df, "sample_id", 3, make, path) == [0, 1, 2]

    def fail(rows):
        return rows.withColumn("id", F.raise_error(F.lit("stopped")))

    with pytest.raises(Exception, match="stopped"):
        writers.write_pending_buckets(df, "sample_id", 5, fail, path)
    assert writers.write_pending_buckets(df, "sample_id", 5, make, path) == [3, 4]
    assert writers.write_pending_buckets(df, "sample_id", 5, make, path) == []
    assert seen == [[0, 1, 2], [3, 4]]
    assert spark.read.parquet(path).count() == 80


def test_write_if_absent_resumes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.write_if_absent(spark, lambda: spark.range(3), path)
    assert not writers.write_if_absent(spark, lambda: 1 / 0, path)
    assert spark.read.parquet(path).count() == 3


def test_shared_folder_must_be_named(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        tables.shared_folder(Session)


def test_responses(spark):
    good = json.dumps([{"species_id": 1, "scientific_name": "A", "filter_is_in_europe": None},
                       {"species_id": 2, "scientific_name": "B", "filter_is_in_europe": False}])
    df = spark.createDataFrame([("b1", good), ("b2", good[:-3]), ("b3", "sorry"), ("b4", "[]")], "batch string, text string")
    rows = records.parse_structured(df, ["batch"], "text", records.FILTER_SCHEMA)
    got = {(r.batch, r.is_corrupt, r.species_id) for r in rows.collect()}
    assert got == {("b1", False, 1), ("b1", False, 2), ("b2", True, None), ("b3", True, None), ("b4", False, None)}
    flagged = records.three_valued_filter(rows.where("species_id is not null"), ["filter_is_in_europe", "filter_is_vascular"])
    assert {r.species_id: r.rejected for r in flagged.collect()} == {1: False, 2: True}
    asked = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 1)], "batch string, species_id int")
    report = records.validate_batch(asked, rows.where("species_id is not null"), "batch", "species_id")
    assert {r.batch: (r.n_missing, r.n_unexpected, r.status) for r in report.collect()} == {
        "b1": (0, 0, "ok"), "b2": (1, 0, "failed")}


def test_scene_schema_parses(spark):
    text = json.dumps([{"image_filename": "a.jpg", "derived_season": "Monsoon", "cover_veg_pct": 40, "trait_leaf_types": ["oval"]}])
    df = spark.createDataFrame([("b", text)], "batch string, text string")
    rows = records.parse_structured(df, ["batch"], "text", records.SCENE_SCHEMA)
    assert len(rows.columns) == 36
    report = records.validate_batch(rows.select("batch", "image_filename"), rows, "batch", "image_filename", records.SCENE_ENUMS)
    assert report.first().n_bad == 1


def test_record_blocks(spark):
    text = "---\nspecies_id: 7\nname: Urtica: dioica\n\n---\nname: Abies\nname: again\n---\n"
    df = spark.createDataFrame([("f", text)], "file string, text string")
    got = [tuple(r) for r in records.parse_record_blocks(df, ["file"], "text", ["species_id", "name"]).orderBy("block").collect()]
    assert got == [("f", 0, "7", "Urtica: dioica"), ("f", 1, None, "Abies")]


def test_scorer_survives_save_and_load(spark, tmp_path):
    np.save(tmp_path / "w.npy", np.array([[1.0, 2.0], [0.5, -1.0]]))
    scorer = scoring.BatchScorer(inputCol="v", outputCol="o", modelPath=str(tmp_path / "w.npy"), inputWidth=2, batchSize=2)
    scorer.write().overwrite().save(str(tmp_path / "scorer"))
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 4.0],), ([3.0, 0.0],)], "v array<double>")
    got = scoring.BatchScorer.load(str(tmp_path / "scorer")).transform(df).select("o.logits").collect()
    assert [r.logits for r in got] == [[2.0, 0.0], [2.0, -4.0], [3.0, 6.0]]


def test_failing_rows_are_kept(spark):
    def make():
        def predict(x):
            if x < 0:
                raise ValueError("negative")
            return [float(x) ** 0.5]

        return predict

    df = spark.createDataFrame([(4,), (-1,)], "x int")
    got = {r.x: (r.output, r.error) for r in scoring.safe_scores(df, "x", make).collect()}
    assert got == {4: ([2.0], None), -1: (None, "ValueError: negative")}


def test_file_stream_takes_only_new_files(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for name in ("a.jpg", "b.jpg", "c.txt"):
        (source / name).write_bytes(name.encode())
    for expected in (2, 3):
        run = feeds.ingest_files(feeds.stream_files(spark, str(source)), out, state, 3)
        run.awaitTermination()
        assert spark.read.parquet(out).count() == expected
        (source / "d.jpg").write_bytes(b"d")
    assert spark.read.parquet(out).where("image_name = 'd.jpg'").count() == 1


def test_late_records_are_dropped(spark, tmp_path):
    def doc(minute, pid):
        return json.dumps({"nvidia_smi_log": {"timestamp": f"Wed Feb 05 {10 + minute // 60}:{minute % 60:02d}:00 2025", "gpu": {
            "processes": {"process_info": {"pid": pid, "used_memory": "1 MiB"}}}}})

    source, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    batches = [[(1, "a"), (2, "a")], [(40, "a")], [(3, "a"), (95, "a")], [(96, "a")]]
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(doc(*d) for d in batch))
        run = feeds.write_windows(feeds.windowed_usage(feeds.stream_telemetry(spark, str(source))), out, state)
        run.awaitTermination()
    got = sorted((r.start.strftime("%H:%M"), r.interval_count) for r in spark.read.parquet(out).collect())
    assert got == [("10:00", 2), ("10:40", 1)]


def test_hot_bucket_is_split_and_small_ones_are_one_file(spark, tmp_path):
    """A third of the rows are in one bucket; it gets several files, every other bucket one."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "400k", "spark.sql.shuffle.partitions": "200"}
    rows = spark.range(60_000).repartition(16).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40 + 1).cast("int").alias("bucket"),
        "id",
        F.sha2(F.col("id").cast("string"), 512).alias("data"),
    )
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writers.write_bucketed_dirs(rows, str(tmp_path / "out"), "bucket")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").glob("bucket=*")}
    hot = files.pop("bucket=0")
    assert hot > 3 and len(files) == 40
    assert sum(n == 1 for n in files.values()) >= 36  # but for those that share a partition with the hot one
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60_000


def test_folders_of_suppliers_are_written_by_tasks(spark, tmp_path):
    """One folder for each key; an absent name is an empty line, as Spark's text writer gives it."""
    from checks import views

    rows = [(i, f"name {i}" if i else None) for i in range(30)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    views.write_folders(spark, str(tmp_path), f"file:{tmp_path}/out")
    found = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert found == {f"s_suppkey={i}": f"{name or ''}\n" for i, name in rows}


def test_lists_are_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    """The number of tasks that collect lists follows the table, not Spark's number of shuffle partitions."""
    from checks import views

    d = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, views.pred_lists(spark, d).collect()))
    monkeypatch.setattr(views, "LIST_ROWS", 500)
    lists = views.pred_lists(spark, d)
    assert lists.rdd.getNumPartitions() == -(-views.table(spark, d, "lineitem").count() // 500) > 4
    assert sorted(map(tuple, lists.collect())) == whole
