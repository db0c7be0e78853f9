"""Retrieval and distance queries."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from tileflow.functions import vectors as vec
from tileflow.operators import joins, neighbours as nn, priors, quantiles, thresholds
from tileflow.plans import retrieval
from tileflow.plans import submission
from tileflow.sources.tables import settle


def neighbour_rows(spark, d, k=10):
    """The k nearest vectors of every tile, with the tile they belong to."""
    t = v.tiles(spark, d)
    found = nn.knn_exact(t, t, k)
    return found.join(t.select(F.col("vec_id").alias("query_id"), "image_name", "tile"), "query_id").select(
        "query_id", "image_name", "tile", F.lit("4x4").alias("grid"), "rank", "nn_id", "distance"
    )


def knn_table(spark, d, k=10):
    t = v.tiles(spark, d)
    keep = t.select(F.col("vec_id").alias("query_id"), "image_name", "tile", F.lit("4x4").alias("grid"))
    return settle(nn.neighbour_arrays(nn.knn_exact(t, t, k), keep), "knn")


def image_species_distances(spark, d):
    return retrieval.species_distances(neighbour_rows(spark, d), retrieval.id_map(v.tiles(spark, d)))


NAMED = v.KNN + """,
named as (select t.image_name, t.tile, s.species_id, k.nn_id, k.rank, k.distance from knn k
  join tile_vec t on t.vec_id = k.query_id join tile_vec s on s.vec_id = k.nn_id),
med as (select image_name, tile, species_id, median(distance) m from named group by all),
species_dist as (select image_name, species_id, min(m) min_med_distance from med group by all)"""


@query("jon17_knn_exact", f"with {v.KNN} select query_id, rank, nn_id, round(distance, 6) distance from knn")
def knn_exact(spark, d):
    t = v.tiles(spark, d)
    return nn.knn_exact(t, t, 10).withColumn("distance", F.round("distance", 6))


@query("jon17_knn_exact_many_cells", f"with {v.KNN} select query_id, rank, nn_id, round(distance, 6) distance from knn")
def knn_exact_many_cells(spark, d):
    t = v.tiles(spark, d)
    return nn.knn_exact(t, t, 10, pivots=32).withColumn("distance", F.round("distance", 6))


@query("jon17_knn_exact_two_levels", f"with {v.KNN} select query_id, rank, nn_id, round(distance, 6) distance from knn")
def knn_exact_two_levels(spark, d):
    t = v.tiles(spark, d)
    return nn.knn_exact(t, t, 10, pivots=150).withColumn("distance", F.round("distance", 6))


@query("jon18_knn_approx")
def knn_approx(spark, d):
    t = v.tiles(spark, d)
    return nn.knn_approx(t, t, 10, pivots=64).withColumn("distance", F.round("distance", 6))


@query("jon18_knn_recall", f"""with {v.KNN}
  select count(*) neighbours, true two_levels, true reached from knn where query_id % 20 = 0""")
def knn_recall(spark, d):
    """The approximate search over many cells against the exact one, for the queries whose id 20 divides."""
    t = v.tiles(spark, d)
    asked = t.where("vec_id % 20 = 0")
    index = nn.build_index(t, "vec_id", "embedding", pivots=150, codes=True)
    exact = nn.search(index, asked, "vec_id", "embedding", 10).select("query_id", "nn_id")
    found = nn.search_codes(index, asked, "vec_id", "embedding", 10).select("query_id", "nn_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "nn_id"], "left")
    return both.agg(
        F.count("*").alias("neighbours"),
        F.lit(index.n_leaves > len(index.centres)).alias("two_levels"),
        (F.count("hit") / F.count("*") >= 0.9).alias("reached"),
    )


@query("jon04_join_id_map", f"""with {NAMED}
  select image_name, tile, nn_id, species_id, round(distance, 6) distance from named""")
def join_id_map(spark, d):
    rows = joins.join_id_map(neighbour_rows(spark, d), retrieval.id_map(v.tiles(spark, d)))
    return rows.select("image_name", "tile", "nn_id", "species_id", F.round("distance", 6).alias("distance"))


@query("agg08_min_of_medians", f"""with {NAMED}
  select image_name, species_id, round(min_med_distance, 6) min_med_distance from species_dist""")
def min_of_medians(spark, d):
    return image_species_distances(spark, d).withColumn("min_med_distance", F.round("min_med_distance", 6))


@query("win03_percentile_threshold_by_image", f"""with {NAMED},
  lim as (select image_name, quantile_disc(min_med_distance, 0.3) threshold from species_dist group by image_name)
  select s.image_name, species_id, round(min_med_distance, 6) min_med_distance, round(threshold, 6) threshold
  from species_dist s join lim using (image_name) where min_med_distance <= threshold""")
def percentile_threshold(spark, d):
    dist = settle(image_species_distances(spark, d))
    return thresholds.percentile_threshold_by_image(dist, "min_med_distance", 0.3).select(
        "image_name", "species_id", F.round("min_med_distance", 6).alias("min_med_distance"),
        F.round("threshold", 6).alias("threshold"),
    )


@query("win04_global_threshold_topn", f"""with {NAMED},
  lim as (select quantile_disc(min_med_distance, 0.4) threshold from species_dist),
  kept as (select *, row_number() over (partition by image_name order by min_med_distance, species_id) rank
    from species_dist, lim where min_med_distance <= threshold)
  select image_name, species_id, rank, round(min_med_distance, 6) min_med_distance from kept where rank <= 3""")
def global_threshold(spark, d):
    dist = settle(image_species_distances(spark, d))
    return thresholds.global_threshold_topn(dist, "min_med_distance", 0.4, 3).select(
        "image_name", "species_id", "rank", F.round("min_med_distance", 6).alias("min_med_distance")
    )


CLASSIFY = """select substring_index_plot plot_id, concat('[', coalesce(ids, ''), ']') species_ids from (
  select regexp_extract(a.image_name, '^[^.]*') substring_index_plot,
    (select string_agg(k.species_id::varchar, ', ' order by k.min_med_distance, k.species_id)
     from kept k where k.image_name = a.image_name) ids
  from (select distinct image_name from tile_vec) a)"""


@query("ml14_knn_classify", f"""with {NAMED},
  lim as (select image_name, quantile_disc(min_med_distance, 0.3) threshold from species_dist group by image_name),
  kept as (select s.* from species_dist s join lim using (image_name) where min_med_distance <= threshold) {CLASSIFY}""")
def knn_classify(spark, d):
    ids = retrieval.id_map(v.tiles(spark, d))
    return retrieval.knn_classify(knn_table(spark, d), ids, [4], k=10, p=0.3)


@query("ml14_knn_classify_global", f"""with {NAMED},
  lim as (select quantile_disc(min_med_distance, 0.1) threshold from species_dist),
  kept as (select * from (select *, row_number() over (partition by image_name order by min_med_distance, species_id) rn
    from species_dist, lim where min_med_distance <= threshold) where rn <= 10) {CLASSIFY}""")
def knn_classify_global(spark, d):
    ids = retrieval.id_map(v.tiles(spark, d))
    return retrieval.knn_classify(knn_table(spark, d), ids, [4], k=10, p=0.1, mode="global")


@query("top08_slice_neighbours", f"""with {v.KNN}
  select query_id, string_agg(nn_id::varchar, ',' order by rank) nn_ids,
    round(sum(distance), 6) total from knn where rank <= 5 group by query_id""")
def slice_neighbours(spark, d):
    cut = nn.slice_neighbours(knn_table(spark, d), 5)
    return cut.select(
        "query_id", F.array_join(F.col("nn_ids").cast("array<string>"), ",").alias("nn_ids"),
        F.round(vec.total(F.col("distances")), 6).alias("total"),
    )


@query("arr08_zip_explode_neighbours", f"""with {v.KNN}
  select query_id, rank, nn_id, round(distance, 6) distance from knn""")
def zip_explode(spark, d):
    return nn.zip_explode_neighbours(knn_table(spark, d), ["query_id"]).withColumn("distance", F.round("distance", 6))


CENTROIDS = v.TILE + """,
cent as (select species_id cid, i, avg(x) c from tile_num group by species_id, i),
cu as (select cid, i, c / sqrt(sum(c * c) over (partition by cid)) c from cent),
tu as (select vec_id, image_name, tile, i, x / sqrt(sum(x * x) over (partition by vec_id)) u from tile_num),
cs as (select vec_id, image_name, tile, cid, sum(u * c) cosine from tu join cu using (i) group by all)"""


def centroids(spark, d):
    return priors.mean_vector_by_group(v.tiles(spark, d), ["species_id"], "embedding")


def distance_job(score, top=None, **options):
    def run(spark, d):
        out = nn.distance_table(
            v.tiles(spark, d), centroids(spark, d), "vec_id", "embedding", "species_id", "mean_vector", score, top,
            **options,
        )
        return out.withColumn("score", F.round("score", 6))

    return run


query("jon16_all_pairs_cosine", f"with {CENTROIDS} select vec_id, cid species_id, round(cosine, 6) score from cs")(
    distance_job("cosine"))
query("jon16_all_pairs_cosine_in_parts", f"with {CENTROIDS} select vec_id, cid species_id, round(cosine, 6) score from cs")(
    distance_job("cosine", limit_bytes=2000))
query("jon16_all_pairs_euclidean", f"""with {CENTROIDS}
  select vec_id, cid species_id, round(sqrt(greatest(0, 2 - 2 * cosine)), 6) score from cs""")(distance_job("euclidean"))
query("arr05_cosine_softmax", f"""with {CENTROIDS}
  select vec_id, cid species_id, round(exp(cosine) / sum(exp(cosine)) over (partition by vec_id), 6) score from cs""")(
    distance_job("cosine_softmax"))
query("arr05_inv_sq_distance_score", f"""with {CENTROIDS}
  select vec_id, cid species_id,
    round(1 / (2 - 2 * cosine) / sum(1 / (2 - 2 * cosine)) over (partition by vec_id), 6) score from cs""")(
    distance_job("inv_sq_distance"))


@query("ml13_centroid_classify", f"""with {CENTROIDS},
  sm as (select *, exp(cosine) / sum(exp(cosine)) over (partition by vec_id) p from cs),
  tk as (select * from (select *, row_number() over (partition by vec_id order by p desc, cid) r from sm) where r <= 3),
  mg as (select *, row_number() over (partition by image_name order by p desc, cid, tile) pos from tk),
  cut as (select * from mg where pos <= 10),
  dd as (select image_name, cid, min(pos) pos from cut group by all)
  select image_name, string_agg(cid::varchar, ', ' order by pos) species_ids from dd group by image_name""")
def centroid_classify(spark, d):
    lists = submission.centroid_classify(
        v.tiles(spark, d), "embedding", "species_id", tile_k=3, k=10
    )
    return lists.select(
        "image_name", F.array_join(F.col("species_ids").cast("array<string>"), ", ").alias("species_ids")
    )


@query("agg09_global_percentile", """select quantile_disc(l_extendedprice, 0.05) p05,
  quantile_disc(l_extendedprice, 0.5) p50, quantile_disc(l_extendedprice, 0.95) p95 from lineitem""")
def global_percentile(spark, d):
    line = v.table(spark, d, "lineitem")
    found = quantiles.exact_percentiles(line, [], "l_extendedprice", (0.05, 0.5, 0.95))
    return found.select(*[F.col(f"q{i}").alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query("agg09_global_percentile_in_bins", """select quantile_disc(l_extendedprice, 0.05) p05,
  quantile_disc(l_extendedprice, 0.5) p50, quantile_disc(l_extendedprice, 0.95) p95 from lineitem""")
def global_percentile_in_bins(spark, d):
    line = v.table(spark, d, "lineitem")
    found = quantiles.exact_percentiles(line, [], "l_extendedprice", (0.05, 0.5, 0.95), gather=100)
    return found.select(*[F.col(f"q{i}").alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query("win03_percentile_by_supplier_in_bins", """select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, lim threshold
  from lineitem join (select l_suppkey, quantile_disc(l_extendedprice, 0.1) lim from lineitem group by 1) using (l_suppkey)
  where l_extendedprice <= lim""")
def percentile_by_supplier_in_bins(spark, d):
    line = v.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return thresholds.percentile_threshold_by_image(line, "l_extendedprice", 0.1, by="l_suppkey", gather=20)


@query("win03_percentile_by_supplier", """select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from lineitem
  join (select l_suppkey, quantile_disc(l_extendedprice, 0.1) lim from lineitem group by 1) using (l_suppkey)
  where l_extendedprice <= lim""")
def percentile_by_supplier(spark, d):
    line = v.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return thresholds.percentile_threshold_by_image(line, "l_extendedprice", 0.1, by="l_suppkey").drop("threshold")
