import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import all_queries, compare
from tileflow.operators import neighbours as nn
from tileflow.operators.numbering import top_rows


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def brute(queries, index, k):
    d = ((unit(queries)[:, None, :] - unit(index)[None, :, :]) ** 2).sum(2).round(9)
    order = np.lexsort((np.broadcast_to(np.arange(len(index)), d.shape), d), axis=1)[:, :k]
    return {(q, r + 1): (int(i), d[q, i]) for q, row in enumerate(order) for r, i in enumerate(row)}


def table(spark, x, kind="double"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id bigint, v array<{kind}>").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    index = centres[rng.integers(0, 6, 400)] + rng.normal(scale=0.1, size=(400, 8))
    index[100:240] = index[100]  # a third of all rows are one point
    index[399] = 0
    return centres[rng.integers(0, 6, 60)] + rng.normal(scale=0.2, size=(60, 8)), index


@pytest.mark.parametrize("pivots", [1, 3, 12, None])
@pytest.mark.parametrize("k", [1, 7, 150])
def test_exact_matches_brute_force(spark, data, k, pivots, monkeypatch):
    monkeypatch.setattr(nn, "_BLOCK_ROWS", 16)  # many blocks, several slots per cell
    monkeypatch.setattr(nn, "_SLOT_BLOCKS", 2)
    queries, index = data
    got = nn.knn_exact(table(spark, queries), table(spark, index), k, "id", "id", "v", pivots=pivots)
    found = {(r.query_id, r["rank"]): (r.nn_id, r.distance) for r in got.collect()}
    want = brute(queries, index, k)
    assert found.keys() == want.keys()
    for key, (i, d) in want.items():
        assert found[key][1] == pytest.approx(d, abs=1e-8)
        assert found[key][0] == i


def test_fewer_rows_than_k(spark):
    x = np.eye(3)
    got = nn.knn_exact(table(spark, x), table(spark, x), 5, "id", "id", "v").collect()
    assert len(got) == 9


def test_cells_are_pruned(spark):
    """A query does not travel to cells that cannot hold a neighbour, and full packs meet the blocks."""
    rng = np.random.default_rng(1)
    centres = unit(rng.normal(size=(4, 16))) * 5
    index = np.concatenate([c + rng.normal(scale=0.01, size=(50, 16)) for c in centres])
    built = nn.build_index(table(spark, index), "id", "v", pivots=40)
    asked = nn._queries(table(spark, index[:10]), "id", "v")
    assert nn.search(built, table(spark, index[:10]), "id", "v", 3).count() == 30
    assert built.blocks.agg(F.sum("n")).first()[0] == 200
    routed = nn._route(built, asked.withColumn("bound", F.lit(0.01)), 3).join(built.blocks.select("leaf", "upper"), "leaf")
    own = {u for u, *_ in routed.select("upper").collect()}
    for u in own:
        assert ((built.centres[u] - unit(centres)[0]) ** 2).sum() < 0.01


@pytest.fixture(scope="module")
def many(spark):
    """4,000 vectors around 40 centres in two levels of pivots; a third of all rows are one point."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + rng.normal(scale=0.3, size=(4000, 8))
    x[: len(x) // 3] = x[0]
    t = table(spark, x).persist()
    yield x, t, nn.build_index(t, "id", "v", pivots=300, codes=True, recall=0.98)
    t.unpersist()


def test_two_levels_match_brute_force(spark, many, monkeypatch):
    x, t, built = many
    assert len(built.centres) == 18 and built.n_leaves > 150
    assert built.blocks.agg(F.sum("n")).first()[0] == len(x) and built.held.sum() == len(x)
    asked = t.where("id % 20 = 7")
    want = brute(x[7::20], x, 10)
    for chunk, slots in [(1024, 16), (4, 1)]:  # lower pivots in several chunks, hot ones in several slots
        monkeypatch.setattr(nn, "_CHUNK_LEAVES", chunk)
        monkeypatch.setattr(nn, "_SLOT_BLOCKS", slots)
        monkeypatch.setattr(nn, "_BLOCK_ROWS", 4096 if slots > 1 else 64)
        tree = built if slots > 1 else nn.build_index(t, "id", "v", pivots=300)
        assert (tree.n_slots > tree.n_leaves) == (slots == 1)
        got = {(r.query_id, r["rank"]): (r.nn_id, r.distance) for r in nn.search(tree, asked, "id", "v", 10).collect()}
        assert len(got) == len(want)
        for (q, rank), (i, d) in want.items():
            assert got[7 + 20 * q, rank] == (i, pytest.approx(d, abs=1e-8))


def test_codes_reach_their_recall(spark, many):
    """In the distinct two thirds, at most the recall asked for is lost, and few cells are looked into."""
    x, t, built = many
    built = nn.load_index(spark, built.path)
    uppers, leaves = built.probes
    assert uppers < len(built.centres) and uppers * leaves < built.n_leaves / 2
    asked = t.where("id % 20 = 0 and id >= 1400")
    want = {(q, i) for (q, _), (i, _) in brute(x[1400::20], x, 10).items()}
    got = nn.search_codes(built, asked, "id", "v", 10).collect()
    hits = sum(((r.query_id - 1400) // 20, r.nn_id) in want for r in got)
    print("recall", hits / len(want), "probes", built.probes, "of", len(built.centres), built.n_leaves)
    assert len(got) == len(want) and hits / len(want) >= 0.9
    gaps = ((unit(x)[[r.query_id for r in got]] - unit(x)[[r.nn_id for r in got]]) ** 2).sum(1)
    assert np.allclose([r.distance for r in got], gaps, atol=1e-9)


def test_codes_with_all_cells_and_a_whole_list_are_exact(spark, data):
    queries, index = data
    q, i = table(spark, queries), table(spark, index)
    exact = set(map(tuple, nn.knn_exact(q, i, 5, "id", "id", "v", 8).select("query_id", "nn_id").collect()))
    every = nn.knn_approx(q, i, 5, (8, 1), "id", "id", "v", 8, short=400)
    assert set(map(tuple, every.select("query_id", "nn_id").collect())) == exact


@pytest.mark.parametrize("score", ["cosine", "euclidean", "cosine_softmax", "inv_sq_distance"])
@pytest.mark.parametrize("top", [None, 2])
def test_distance_table_in_parts(spark, data, score, top):
    queries, index = data
    centroids = index[:7].copy()
    centroids[2] = queries[0]  # one distance of zero
    q, c = table(spark, queries), table(spark, centroids).withColumnsRenamed({"id": "cid", "v": "cv"})
    whole = nn.distance_table(q, c, "id", "v", "cid", "cv", score, top)
    parts = nn.distance_table(q, c, "id", "v", "cid", "cv", score, top, limit_bytes=8 * 8 * 2)
    a = sorted((r.id, r.cid, round(r.score, 9)) for r in whole.collect())
    b = sorted((r.id, r.cid, round(r.score, 9)) for r in parts.collect())
    assert a == b
    assert len(a) == len(queries) * (top or 7)
    if score == "inv_sq_distance":
        assert (0, 2, 1.0) in a
    if top is None and score in ("cosine_softmax", "inv_sq_distance"):
        for q_id in range(len(queries)):
            assert sum(s for i, _, s in a if i == q_id) == pytest.approx(1)


def test_copied_blocks_are_not_broadcast(spark, data):
    """Copies of blocks make join keys for many tasks; they stay in proportion to the queries and out of the driver."""
    queries, index = data
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        found = nn.knn_exact(table(spark, queries), table(spark, index), 3, "id", "id", "v", pivots=2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "split" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
        assert found.count() == 180
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert nn._copies(n_slots=2, tasks=200, n_queries=10_256, n_vectors=10_256, vector_bytes=256) == 11
    assert nn._copies(n_slots=25, tasks=200, n_queries=10**5, n_vectors=10**9, vector_bytes=256) == 1


def test_codes_send_k_rows_of_a_pivot(spark, many, monkeypatch):
    """Vectors are compared where their codes are read: no short list of 20 k rows leaves a pivot."""
    _, t, built = many
    merged = []
    monkeypatch.setattr(nn, "top_rows", lambda rows, *rest: merged.append(rows) or top_rows(rows, *rest))
    found = nn.search_codes(built, t.where("id % 20 = 0"), "id", "v", 10)
    most = merged[0].groupBy("query_id", "leaf").count().agg(F.max("count")).first()[0]
    assert len(merged) == 1 and most == 10
    assert found.count() == 2000


def test_best_by_codes_is_exact_where_the_list_holds_the_best(data):
    queries, index = data
    asked, block, ids = unit(queries), unit(index), np.arange(len(index)) * 3
    gaps, found = nn._best_in_block(asked, block, ids, 5)
    by_codes, listed = nn._best_by_codes(asked, block, block.astype(np.float32), ids, 5, 20)
    assert (found == listed).all() and np.allclose(gaps, by_codes, atol=1e-11)


def test_arrow_rows_are_views_of_their_batch():
    """A batch of pairs is not copied to be read; text ids and an empty list work too."""
    ids = pa.array([[3, 1], [], [7]], pa.list_(pa.int64()))
    names = pa.array([["b", "a"], [], ["c"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_pydict({"leaf": [4, 5, 6], "ids": ids, "names": names, "data": pa.array([b"xy", b"", b"z"])})
    rows = list(nn._arrow_rows(iter([batch])))
    assert [(r.leaf, r.ids.tolist(), list(r.names), bytes(r.data)) for r in rows] == [
        (4, [3, 1], ["b", "a"], b"xy"), (5, [], [], b""), (6, [7], ["c"], b"z")]
    assert np.shares_memory(rows[0].ids, batch.column("ids").flatten().to_numpy())
    start, data = batch.column("data").buffers()[2].address, rows[2].data.address
    assert data == start + 2


@pytest.mark.parametrize("k", [1, 7, 150])
def test_queries_that_ask_most_pivots_are_not_sent_to_each(spark, k, monkeypatch):
    """Where no pivot can be ruled out, copies of a query for each would grow with the square of the table."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24))
    x[100:300] = x[100]  # equal vectors go by id
    x[5] = 0
    sent, packs = [], nn._packs
    monkeypatch.setattr(nn, "_ROUTED_BYTES", 0, raising=False)  # a small table may send copies otherwise
    monkeypatch.setattr(nn, "_packs", lambda rows, *rest: sent.append(rows) or packs(rows, *rest))
    t = table(spark, x)
    got = nn.knn_exact(t, t, k, "id", "id", "v", pivots=40)
    found = {(r.query_id, r["rank"]): (r.nn_id, r.distance) for r in got.collect()}
    want = brute(x, x, k)
    assert found.keys() == want.keys()
    for key, (i, d) in want.items():
        assert found[key] == (i, pytest.approx(d, abs=1e-8))
    assert sum(rows.count() for rows in sent) <= 8 * len(x)


def test_scan_takes_text_ids_and_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn, "_ROUTED_BYTES", 0)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24))
    x[7, 3] = np.nan  # no neighbour of any row, and without neighbours
    rows = [(f"t{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)]
    t = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    index = nn.build_index(t.where("id <> 't7'"), "id", "v", pivots=30)
    got = nn.search(index, t, "id", "v", 4).collect()
    y = np.delete(x, 7, 0).astype(np.float32).astype(np.float64)
    want = {(i, n) for (i, _), (n, _) in brute(y, y, 4).items()}
    names = [i + (i > 6) for i in range(299)]
    assert {(r.query_id, r.nn_id) for r in got} == {(f"t{names[i]}", f"t{names[n]}") for i, n in want}
    plan = nn.search(index, t, "id", "v", 4)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "SortMergeJoin" in line and "cell" in line]


@pytest.mark.parametrize("name", ["jon04_join_id_map", "win03_percentile_threshold_by_image"])
def test_queries_on_neighbours_send_no_tile_to_each_pivot(spark, name, tmp_path, monkeypatch):
    """The search below these queries makes no copy of a tile for every pivot, and the rows are those of the SQL."""
    x = np.random.default_rng(6).normal(size=(640, 24))
    x[:80] = x[0]
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(x)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(path)
    sent, packs = [], nn._packs
    monkeypatch.setattr(nn, "_BLOCK_ROWS", 16)  # 40 pivots
    monkeypatch.setattr(nn, "_ROUTED_BYTES", 0, raising=False)
    monkeypatch.setattr(nn, "_packs", lambda rows, *rest: sent.append(rows) or packs(rows, *rest))
    got = all_queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    want = con.execute(all_queries.SQL[name])
    assert compare.rows(got.columns, got.collect()) == compare.rows([c[0] for c in want.description], want.fetchall())
    assert sum(rows.count() for rows in sent) <= 8 * len(x)
