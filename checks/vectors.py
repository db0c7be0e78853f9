"""Vector functions, priors and top-k queries; the 64 vector entries serve as 64 classes."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.shaping import REGION_SQL
from tileflow.functions import lists, vectors as vec
from tileflow.operators import joins, priors
from tileflow.operators.numbering import top_rows
from tileflow.plans import image_priors, submission

def embedding():
    return F.col("embedding")


def entries(df, keep, col, digits=6):
    """Vector column -> rounded rows for the comparison."""
    return df.select(*keep, F.posexplode(col).alias("i", "x")).withColumn("x", F.round("x", digits))


@query("arr01_softmax", f"with {v.PROB} select vec_id, i, round(p, 6) x from prob")
def softmax(spark, d):
    return entries(v.tiles(spark, d), ["vec_id"], vec.softmax(embedding()))


@query("arr02_hill_number", f"with {v.PROB} select vec_id, round(exp(-sum(p * ln(p))), 6) hill from prob group by 1")
def hill(spark, d):
    return v.tiles(spark, d).select("vec_id", F.round(vec.hill_number(vec.softmax(embedding())), 6).alias("hill"))


@query("arr04_l2_normalise", f"with {v.UNIT} select vec_id, i, round(u, 6) x from unit")
def l2(spark, d):
    return entries(v.tiles(spark, d), ["vec_id"], vec.l2_normalise(embedding()))


@query("arr06_normalise_sum", f"""with {v.TILE} select vec_id, i, round(abs(x) / sum(abs(x)) over (partition by vec_id), 6) x from tile_num""")
def normalise_sum(spark, d):
    return entries(v.tiles(spark, d), ["vec_id"], vec.normalise_sum(F.transform(embedding().cast("array<double>"), F.abs)))


PRIOR = v.PROB + """, pm as (select species_id, i, avg(p) m from prob group by all),
prior as (select species_id, i, m / sum(m) over (partition by species_id) prior from pm)"""


def prior(spark, d, joint=False):
    return priors.cluster_prior(v.tiles(spark, d), "species_id", "embedding", joint)


@query("arr07_jon12_apply_prior", f"""with {PRIOR} select vec_id, i, round(p * prior, 8) x from prob join prior using (species_id, i)""")
def apply_prior(spark, d):
    t = joins.join_prior(v.tiles(spark, d), prior(spark, d), "species_id")
    return entries(t, ["vec_id"], vec.apply_prior(vec.softmax(embedding()), F.col("prior_probabilities")), 8)


@query("arr07_apply_prior_renormalised", f"""with {PRIOR}, w as (select vec_id, i, p * prior w from prob join prior using (species_id, i))
  select vec_id, i, round(w / sum(w) over (partition by vec_id), 6) x from w""")
def apply_prior_renormalised(spark, d):
    t = joins.join_prior(v.tiles(spark, d), prior(spark, d), "species_id")
    return entries(t, ["vec_id"], vec.apply_prior(vec.softmax(embedding()), F.col("prior_probabilities"), True))


@query("arr09_posexplode_tiles", f"with {v.TILE} select vec_id, i::int tile, round(x, 6) x from tile_num")
def posexplode_tiles(spark, d):
    return v.tiles(spark, d).select("vec_id", F.posexplode(embedding().cast("array<double>")).alias("tile", "x")).withColumn("x", F.round("x", 6))


@query("arr10_id_prob_rows", f"""with {v.PROB} select vec_id, i class_idx, round(p * 2, 6) score from (select *, row_number() over (
  partition by vec_id order by p desc, i) r from prob) where r <= 5""")
def id_prob_rows(spark, d):
    probs = v.tiles(spark, d).select("vec_id", vec.softmax(embedding()).alias("p"))
    rows = priors.id_prob_rows(probs, ["vec_id"], "p").withColumn("score", F.col("score") * 2)
    best = top_rows(rows, ["vec_id"], [F.desc("score"), "class_idx"], 5)
    return best.select("vec_id", "class_idx", F.round("score", 6).alias("score"))


@query("arr10_id_prob_vector", f"with {v.TILE} select vec_id, i, round(x, 6) x from tile_num")
def id_prob_vector(spark, d):
    rows = priors.id_prob_rows(v.tiles(spark, d), ["vec_id"], "embedding")
    back = priors.id_prob_vector(rows, ["vec_id"])
    return entries(back, ["vec_id"], F.col("vector").cast("array<double>"))


@query("arr11_count_above", f"with {v.TILE} select vec_id, count(*) filter (where x > 0.1) n from tile_num group by 1")
def count_above(spark, d):
    return v.tiles(spark, d).select("vec_id", vec.count_above(embedding(), 0.1).alias("n"))


@query("arr12_or_empty", "select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end n from orders")
def or_empty(spark, d):
    ids = F.when(F.col("o_orderstatus") == "F", F.array(F.col("o_custkey")))
    return v.table(spark, d, "orders").select("o_orderkey", F.size(lists.or_empty(ids)).alias("n"))


@query("agg15_mean_vector_by_group", f"with {v.TILE} select species_id, i, round(avg(x), 6) x from tile_num group by all")
def mean_by_group(spark, d):
    means = priors.mean_vector_by_group(v.tiles(spark, d), ["species_id"], "embedding")
    return entries(means, ["species_id"], F.col("mean_vector"))


def mean_sql(table, value):
    return f"""with {table[0]}, m as (select i class_idx, avg({value}) score from {table[1]} group by 1),
      t as (select *, row_number() over (order by score desc, class_idx) rank from m)
      select image_name, rank, class_idx, round(score, 6) score from (select distinct image_name from tile_vec), t where rank <= 7"""


@query("agg16_mean_vector_global_logits", mean_sql((v.TILE, "tile_num"), "x"))
def mean_global(spark, d):
    return priors.mean_vector_topk(v.tiles(spark, d), "embedding", 7).withColumn("score", F.round("score", 6))


@query("agg16_mean_vector_global_probabilities", mean_sql((v.PROB, "prob"), "p"))
def mean_global_probabilities(spark, d):
    return priors.mean_vector_topk(v.tiles(spark, d), "embedding", 7, "probabilities").withColumn("score", F.round("score", 6))


@query("agg17_cluster_prior", f"with {PRIOR} select species_id, i, round(prior, 6) x from prior")
def cluster_prior(spark, d):
    return entries(prior(spark, d), ["species_id"], F.col("prior_probabilities"))


@query("agg17_cluster_prior_joint", f"""with {v.TILE}, m as (select species_id, i, avg(exp(x - mx)) m from (
  select *, max(x) over (partition by species_id) mx from tile_num) group by all)
  select species_id, i, round(m / sum(m) over (partition by species_id), 6) x from m""")
def cluster_prior_joint(spark, d):
    return entries(prior(spark, d, True), ["species_id"], F.col("prior_probabilities"))


@query("agg34_top_species_per_cluster", f"""with {PRIOR}, r as (select *, row_number() over (partition by species_id order by prior desc, i) rank from prior)
  select species_id, rank, i class_idx, round(prior, 6) probability, s_name from r left join supplier on s_suppkey = i where rank <= 5""")
def top_species(spark, d):
    classes = v.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("class_idx"), "s_name")
    out = priors.top_species_per_cluster(prior(spark, d), "species_id", classes, 5)
    return out.withColumn("probability", F.round("probability", 6))


@query("jon12_image_priors", f"""with {v.PROB}, {v.PLOT}, n as (select vec_id, species_id cluster, {REGION_SQL} region
    from tile_vec join plot_name on o_orderkey = vec_id),
  c as (select region, cluster, count(*) n from n group by all),
  dom as (select region, cluster dominant_cluster from (select *, row_number() over (partition by region order by n desc, cluster) r from c) where r = 1),
  pl as (select vec_id, dominant_cluster from n join dom using (region)),
  m as (select dominant_cluster, i, avg(p) m from prob join pl using (vec_id) group by all),
  pr as (select dominant_cluster, i, m / sum(m) over (partition by dominant_cluster) q from m)
  select vec_id, dominant_cluster, i, round(q, 6) x from pl join pr using (dominant_cluster)""")
def image_prior(spark, d):
    named = v.tiles(spark, d).join(v.plots(spark, d), F.expr("o_orderkey = vec_id"))
    pics = named.select(
        F.concat_ws("/", "quadrat_id", "vec_id").alias("image_name"), F.col("embedding").alias("logits"),
        F.col("species_id").alias("cluster"))
    out = image_priors.image_priors(pics, image_priors.region_clusters(pics))
    keyed = out.withColumn("vec_id", F.element_at(F.split("image_name", "/"), -1).cast("bigint"))
    return entries(keyed, ["vec_id", "dominant_cluster"], F.col("prior_probabilities"))


CUTS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query("win06_cumulative_cutoffs", f"""with {PRIOR}, c as (select species_id, sum(prior) over (partition by species_id order by prior desc, i
  rows unbounded preceding) cum from prior), n as (select t threshold, species_id, count(*) filter (where cum < t) + 1 n
  from c, unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::double[]) u(t) group by all)
  select threshold, round(avg(n), 6) mean_classes from n group by 1""")
def cutoffs(spark, d):
    return priors.cumulative_cutoffs(prior(spark, d), CUTS).withColumn("mean_classes", F.round("mean_classes", 6))


@query("arr03_align_to_classes", f"""with {v.TILE}, m as (select species_id, i, avg(x) x from tile_num group by all),
  c as (select s_suppkey species_id, i from supplier, range(64) r(i))
  select c.species_id, c.i, round(coalesce(x, 0), 6) x from c left join m using (species_id, i)""")
def align(spark, d):
    means = priors.mean_vector_by_group(v.tiles(spark, d), ["species_id"], "embedding")
    classes = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("species_id"))
    out = priors.align_to_classes(means, classes, "species_id", "mean_vector", 64)
    return entries(out, ["species_id"], F.col("mean_vector"))


TOPK = v.TILE + """, r as (select *, row_number() over (partition by vec_id order by x desc, i) rank from tile_num)"""


@query("top03_topk_of_vector", f"with {TOPK} select vec_id, rank, i class_idx, round(x, 6) score from r where rank <= 10")
def topk(spark, d):
    out = v.tiles(spark, d).select("vec_id", F.posexplode(vec.top_entries(embedding(), 10)).alias("pos", "e"))
    return out.select("vec_id", (F.col("pos") + 1).alias("rank"), "e.class_idx", F.round("e.score", 6).alias("score"))


@query("top03_topk_map", f"with {TOPK} select vec_id, i::varchar class_idx, round(x, 6) score from r where rank <= 4")
def topk_map(spark, d):
    out = v.tiles(spark, d).select("vec_id", F.explode(vec.top_entry_map(embedding(), 4)).alias("class_idx", "score"))
    return out.withColumn("score", F.round("score", 6))


MERGE = TOPK + """, mg as (select image_name, tile, i class_idx, x score, row_number() over (
  partition by image_name order by x desc, i, tile) pos from r where rank <= 5)"""


@query("top04_merge_tile_topk", f"with {MERGE} select image_name, tile, class_idx, pos rank, round(score, 6) score from mg where pos <= 20")
def merge_topk(spark, d):
    scores = priors.merge_tile_topk(v.tiles(spark, d), ["image_name", "tile"], "embedding", 5)
    best = top_rows(scores, ["image_name"], [F.desc("score"), "class_idx", "tile"], 20)
    return best.withColumn("score", F.round("score", 6))


@query("top05_topk_then_distinct", f"""with {MERGE}, f as (select image_name, class_idx, min(pos) pos from mg where pos <= 10 group by all)
  select image_name, string_agg(class_idx::varchar, ',' order by pos) species_ids from f group by 1""")
def topk_distinct(spark, d):
    scores = priors.merge_tile_topk(v.tiles(spark, d), ["image_name", "tile"], "embedding", 5)
    out = submission.merge_tiles(scores, 10, item="class_idx")
    return out.select("image_name", F.array_join(F.col("species_ids").cast("array<string>"), ",").alias("species_ids"))
