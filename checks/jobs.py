"""Scoring, clustering, structured responses, telemetry and streams."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from checks import views as v
from checks.rasters import images, tiled, wide_masks
from checks.registry import query
from tileflow.functions import vectors as vec
from tileflow.operators import clusters, priors, records, scoring, telemetry
from tileflow.operators.joins import join_prior
from tileflow.plans import submission, tiles as tile_plans
from tileflow.sources import readers
from tileflow.sources.tables import new_path, settle
from tileflow.streaming import feeds

# -------------------------------------------------------------------------------------- scoring

CLASSES = 10
WEIGHTS = [[((i * 7 + j * 13) % 11 - 5) / 10 for j in range(CLASSES)] for i in range(64)]
LOGITS = v.TILE + f""", logit as (select vec_id, image_name, tile, species_id, j class_idx, sum(x * ((i * 7 + j * 13) % 11 - 5) / 10) l
  from tile_num, range({CLASSES}) r(j) group by all),
lexp as (select *, exp(l - max(l) over (partition by vec_id)) e from logit),
lp as (select *, e / sum(e) over (partition by vec_id) p from lexp)"""


def scored(spark, d):
    scorer = scoring.BatchScorer(inputCol="embedding", outputCol="output", modelPath=json.dumps(WEIGHTS), inputWidth=64)
    return scorer.transform(v.tiles(spark, d))


@query("ml01_batch_scorer", f"with {LOGITS} select vec_id, class_idx, round(l, 5) logit from logit")
def batch_scorer(spark, d):
    out = scored(spark, d).select("vec_id", F.posexplode("output.logits").alias("class_idx", "logit"))
    return out.withColumn("logit", F.round("logit", 5))


@query("ml01_batch_scorer_saved", f"with {LOGITS} select vec_id, class_idx, round(l, 5) logit from logit")
def batch_scorer_saved(spark, d):
    path = new_path(spark, "scorer")
    scoring.BatchScorer(inputCol="embedding", outputCol="o", modelPath=json.dumps(WEIGHTS), inputWidth=64).save(path)
    out = scoring.BatchScorer.load(path).transform(v.tiles(spark, d))
    return out.select("vec_id", F.posexplode("o.logits").alias("class_idx", "logit")).withColumn("logit", F.round("logit", 5))


@query("ml01_batch_scorer_float", f"with {LOGITS} select vec_id, class_idx, l::float::double logit from logit")
def batch_scorer_float(spark, d):
    scorer = scoring.BatchScorer(
        inputCol="embedding", outputCol="o", modelPath=json.dumps(WEIGHTS), inputWidth=64, outputType="float")
    out = scorer.transform(v.tiles(spark, d)).select("vec_id", F.posexplode("o.logits").alias("class_idx", "logit"))
    return out.withColumn("logit", F.col("logit").cast("double"))


COLOUR = "tileflow.operators.scoring:colour_scorer"


def colour_scorer():
    return scoring.BatchScorer(inputCol="data", outputCol="output", scorer=COLOUR, batchSize=8)


TILED3 = tiled("px", 3, extra="c,")


@query("ml02_tile_embed", f"""with {v.PIXELS}, {TILED3} select image_name, tile, c channel, round(avg(v), 5) mean
  from tiled group by all""")
def tile_embed(spark, d):
    out = tile_plans.tile_embed(images(spark, d), colour_scorer(), 3)
    return out.select("image_name", "tile", F.posexplode("cls_embedding").alias("channel", "mean")).withColumn("mean", F.round("mean", 5))


@query("ml03_masked_tile_embed", f"""with {v.PIXELS}, {v.masks_sql("m0", 0)}, {v.masks_sql("m7", 7)},
  long as (select 'leaf_mask' mask_type, * from m0 union all select 'rock_mask', * from m7),
  cut as (select p.image_name, mask_type, p.y, p.x, p.c, p.v * l.v v from px p join long l using (image_name, y, x)),
  {tiled("cut", 3, extra="mask_type, c,")}
  select image_name, tile, mask_type, c channel, round(avg(v), 5) mean from tiled group by all""")
def masked_tile_embed(spark, d):
    out = tile_plans.masked_tile_embed(wide_masks(spark, d), images(spark, d), colour_scorer(), 3, ["leaf_mask", "rock_mask"])
    return out.select("image_name", "tile", "mask_type", F.posexplode("cls_embedding").alias("channel", "mean")).withColumn(
        "mean", F.round("mean", 5))


@query("ml04_tile_classify", f"""with {v.PIXELS}, {TILED3}, m as (select image_name, tile, c, avg(v) l from tiled group by all),
  e as (select *, exp(l - max(l) over (partition by image_name, tile)) e from m),
  p as (select *, e / sum(e) over (partition by image_name, tile) p from e)
  select image_name, tile, c class_idx, round(p * (c + 1) / 6, 6) probability from p""")
def tile_classify(spark, d):
    pics = images(spark, d)
    prior = pics.select("image_name", F.array(*[F.lit((c + 1) / 6) for c in range(3)]).alias("prior_probabilities"))
    out = tile_plans.tile_classify(pics, colour_scorer(), 3, prior)
    return out.select("image_name", "tile", F.posexplode("probabilities").alias("class_idx", "probability")).withColumn(
        "probability", F.round("probability", 6))


@query("ml04_scored_submission", f"""with {LOGITS}, pm as (select species_id, class_idx, avg(p) m from lp group by all),
  pr as (select species_id, class_idx, m / sum(m) over (partition by species_id) q from pm),
  w as (select image_name, tile, class_idx, p * q s from lp join pr using (species_id, class_idx)),
  tk as (select * from (select *, row_number() over (partition by image_name, tile order by s desc, class_idx) r from w) where r <= 4),
  mg as (select *, row_number() over (partition by image_name order by s desc, class_idx, tile) pos from tk),
  f as (select image_name, class_idx, min(pos) pos from mg where pos <= 10 group by all)
  select regexp_replace(image_name, '[.][^.]*$', '') quadrat_id, string_agg(class_idx::varchar, ',' order by pos) species_ids from f group by 1""")
def scored_submission(spark, d):
    logits = settle(scored(spark, d).select("image_name", "tile", "species_id", F.col("output.logits").alias("logits")))
    prior = priors.cluster_prior(logits, "species_id", "logits")
    weighted = join_prior(logits, prior, "species_id").select(
        "image_name", "tile",
        vec.apply_prior(vec.softmax(F.col("logits")), F.col("prior_probabilities")).alias("probabilities"))
    classes = v.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("int").alias("class_idx"), F.col("s_suppkey").alias("species_id"))
    out = submission.tile_predictions(weighted, classes, tile_k=4, k=10)
    return out.select("quadrat_id", F.array_join(F.col("species_ids").cast("array<string>"), ",").alias("species_ids"))


@query("agg14_voted_submission", f"""with {LOGITS}, b as (select * from (select *, row_number() over (partition by image_name, tile
    order by p desc, class_idx) r from lp) where r <= 2),
  c as (select image_name, class_idx, count(*) n from b group by all),
  k as (select *, row_number() over (partition by image_name order by n desc, class_idx) r from c)
  select regexp_replace(image_name, '[.][^.]*$', '') quadrat_id, string_agg(class_idx::varchar, ',' order by r) species_ids
  from k where r <= 5 group by 1""")
def voted_submission(spark, d):
    probs = scored(spark, d).select("image_name", "tile", vec.softmax(F.col("output.logits")).alias("p"))
    rows = priors.id_prob_rows(probs, ["image_name", "tile"], "p").withColumnRenamed("class_idx", "species_id")
    out = submission.voted_predictions(rows, n=2, k=5)
    return out.select("quadrat_id", F.array_join(F.col("species_ids").cast("array<string>"), ",").alias("species_ids"))


def fussy():
    def predict(text):
        if not text.startswith("{"):
            raise ValueError("no record")
        return [float(json.loads(text)["k"])]

    return predict


@query("ml06_ml07_safe_scorer", """select event_id, case when event_id % 5 <> 0 then (props->>'k')::double end k,
  event_id % 5 = 0 failed from events""")
def safe_scorer(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "broken").otherwise(F.col("props"))
    out = scoring.safe_scores(v.table(spark, d, "events").select("event_id", text.alias("text")), "text", fussy)
    return out.select("event_id", F.get("output", F.lit(0)).alias("k"), F.col("error").isNotNull().alias("failed"))


# ------------------------------------------------------------------------------------- clusters


@query("ml08_standardise", f"""with {v.TILE}, s as (select *, avg(x) over (partition by i) m, stddev_pop(x) over (partition by i) sd from tile_num)
  select vec_id, i, round((x - m) / sd, 5) x from s""")
def standardise(spark, d):
    out = clusters.standardise(v.tiles(spark, d), "embedding")
    return out.select("vec_id", F.posexplode("scaled").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("ml09_pca_project")
def pca_project(spark, d):
    out = clusters.pca_project(v.tiles(spark, d), "embedding", 2)
    return out.select("vec_id", *[F.round(F.abs(F.col("projection")[i]), 5).alias(f"axis{i}") for i in (0, 1)])


@query("ml09_pca_axes", f"""with {v.TILE}, spread as (select i, var_samp(x) s from tile_num group by i)
  select (select count(*) from tile_vec) n, round(sum(s), 6) all_variance, true ordered, true uncorrelated, true widest from spread""")
def pca_axes(spark, d):
    """What makes axes the main ones: falling variance, no correlation, and no entry that varies more than the first."""
    t = v.tiles(spark, d)
    out = clusters.pca_project(t, "embedding", 2)
    x, y = (F.col("projection")[i] for i in (0, 1))
    axes = out.agg(F.count("*").alias("n"), F.var_samp(x).alias("x"), F.var_samp(y).alias("y"), F.covar_samp(x, y).alias("xy"))
    entries = t.select(F.posexplode("embedding").alias("i", "e")).groupBy("i").agg(F.var_samp("e").alias("s"))
    entries = entries.agg(F.round(F.sum("s"), 6).alias("all_variance"), F.max("s").alias("most"), F.sum("s").alias("total"))
    return axes.withColumn("e", entries.select(F.struct("*")).scalar()).select("n", "x", "y", "xy", "e.*").select(
        "n",
        "all_variance",
        ((F.col("x") >= F.col("y")) & (F.col("x") + F.col("y") <= F.col("total") + 1e-9)).alias("ordered"),
        (F.abs("xy") < 1e-9).alias("uncorrelated"),
        (F.col("x") >= F.col("most") - 1e-9).alias("widest"),
    )


def settled(rows, vec_col):
    """One row: rows, clusters, and whether (nearly) all rows are nearest to the mean of their own cluster."""
    means = settle(priors.mean_vector_by_group(rows, ["cluster"], vec_col, "mean"), "means")
    table = means.agg(F.collect_list(F.struct("cluster", "mean")).alias("means"))  # one for each cluster
    gap = lambda m: F.aggregate(F.zip_with(m, F.col(vec_col), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    gaps = F.transform("means", lambda m: F.struct(gap(m["mean"]).alias("gap"), m["cluster"].alias("cluster")))
    near = rows.withColumn("means", table.scalar()).select("cluster", F.array_min(gaps)["cluster"].alias("near"))
    return near.agg(
        F.count("*").alias("n"),
        F.countDistinct("cluster").alias("clusters"),
        (F.avg((F.col("cluster") == F.col("near")).cast("int")) >= 0.95).alias("settled"),
    )


@query("ml10_kmeans_settled", "select count(*) n, 5 clusters, true settled from embeddings")
def kmeans_settled(spark, d):
    return settled(clusters.kmeans(v.tiles(spark, d), "embedding", 5, seed=1), "embedding")


@query("ml11_cluster_pipeline_settled", "select count(*) n, 3 clusters, true settled from embeddings")
def cluster_pipeline_settled(spark, d):
    data = v.tiles(spark, d)
    return settled(clusters.predict_clusters(clusters.fit_clusters(data, "embedding", 3, seed=1), data, "embedding"), "projection")


@query("ml10_kmeans")
def kmeans(spark, d):
    out = clusters.kmeans(v.tiles(spark, d), "embedding", 5, seed=1)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query("ml11_cluster_pipeline")
def cluster_pipeline(spark, d):
    data = v.tiles(spark, d)
    path = new_path(spark, "model")
    clusters.fit_clusters(data, "embedding", 3, seed=1).write().save(path)
    out = clusters.predict_clusters(PipelineModel.load(path), data, "embedding")
    return out.select("vec_id", "cluster")


@query("ml12_species_centroids")
def species_centroids(spark, d):
    out = clusters.species_centroids(v.tiles(spark, d), "species_id", "embedding", "vec_id", n=3)
    return out.select("species_id", "centroid", F.round(vec.total(F.col("centre")), 5).alias("total"))


LLOYD = f"""with recursive {v.TILE},
ranked as (select *, dense_rank() over (partition by species_id order by vec_id) - 1 r from tile_num),
lloyd(it, species_id, centroid, i, m) as (select 0, species_id, r, i, x from ranked where r < 3
  union all select any_value(it) + 1, species_id, centroid, i, avg(x) from (
    select it, t.species_id, centroid, t.i, t.x from tile_num t join (
      select it, vec_id, l.centroid, row_number() over (partition by vec_id order by sum((x - m) * (x - m)), l.centroid) place
      from lloyd l join tile_num t on t.species_id = l.species_id and t.i = l.i where it < 20 group by it, vec_id, l.centroid) n
    on t.vec_id = n.vec_id and place = 1) group by species_id, centroid, i)"""


@query("ml12_species_centroids_lloyd", LLOYD + """
  select species_id, centroid, i, round(m, 5) x from lloyd where it = (select max(it) from lloyd)""")
def lloyd_centroids(spark, d):
    out = clusters.species_centroids(v.tiles(spark, d), "species_id", "embedding", "vec_id", n=3, start=F.col("vec_id"))
    return out.select("species_id", "centroid", F.posexplode("centre").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("ml12_species_centroids_in_rounds", LLOYD + """
  select species_id, centroid, i, round(m, 5) x from lloyd where it = (select max(it) from lloyd)""")
def lloyd_in_rounds(spark, d):
    """The way of large species, for the species above 20,000 bytes."""
    t = v.tiles(spark, d)
    out = clusters.species_centroids(t, "species_id", "embedding", "vec_id", n=3, start=F.col("vec_id"), held_bytes=20_000)
    return out.select("species_id", "centroid", F.posexplode("centre").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("ml12_species_centroids_single", f"with {v.TILE} select species_id, i, round(avg(x), 6) x from tile_num group by all")
def single_centroid(spark, d):
    out = clusters.species_centroids(v.tiles(spark, d), "species_id", "embedding", "vec_id", n=1)
    return out.select("species_id", F.posexplode("centre").alias("i", "x")).withColumn("x", F.round("x", 6))


# -------------------------------------------------------------------------- structured responses


def answers(spark, d):
    """One JSON response per customer; one in eleven is cut off."""
    c = v.table(spark, d, "customer")
    key = F.col("c_custkey")

    def maybe(n):
        return F.when(key % n == 0, False).when(key % n == 1, True)

    record = F.struct(
        key.cast("int").alias("species_id"), F.col("c_name").alias("scientific_name"), F.lit(True).alias("filter_is_vascular"),
        maybe(3).alias("filter_is_quadrat_relevant"), maybe(5).alias("filter_is_in_europe"),
        maybe(7).alias("filter_is_in_pyrenees_med"), F.col("c_mktsegment").alias("justification"))
    text = F.to_json(F.array(record))
    cut = F.when(key % 11 == 0, F.expr("substring(text, 1, length(text) - 2)")).otherwise(F.col("text"))
    return c.withColumn("text", text).select(F.col("c_nationkey").alias("batch"), key.alias("request"), cut.alias("text"))


@query("rec01_parse_structured", """select c_nationkey batch, c_custkey request, c_custkey % 11 = 0 is_corrupt,
  case when c_custkey % 11 <> 0 then c_custkey::int end species_id, case when c_custkey % 11 <> 0 then c_name end scientific_name,
  case when c_custkey % 11 = 0 then null when c_custkey % 3 = 0 then false when c_custkey % 3 = 1 then true end filter_is_quadrat_relevant
  from customer""")
def parse_structured(spark, d):
    rows = records.parse_structured(answers(spark, d), ["batch", "request"], "text", records.FILTER_SCHEMA)
    return rows.select("batch", "request", "is_corrupt", "species_id", "scientific_name", "filter_is_quadrat_relevant")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "HOUSEHOLD")


@query("rec02_validate_batch", """with r as (select c_custkey // 8 batch, c_custkey % 11 = 0 missing,
    c_custkey % 11 <> 0 and c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') bad from customer)
  select batch, count(*) filter (where missing) n_missing, 0 n_unexpected, count(*) filter (where bad) n_bad,
    case when bool_or(missing or bad) then 'failed' else 'ok' end status from r group by 1""")
def validate_batch(spark, d):
    batch = F.floor(F.col("request") / 8).alias("batch")
    asked = v.table(spark, d, "customer").select(F.col("c_custkey").alias("request")).select(batch, "request")
    text = answers(spark, d).select(batch, "request", "text")
    given = records.parse_structured(text, ["batch", "request"], "text", records.FILTER_SCHEMA).where("not is_corrupt")
    return records.validate_batch(asked, given, "batch", "request", {"justification": SEGMENTS}, ["scientific_name"])


@query("rec02_write_validated", """with r as (select c_custkey // 4 batch, bool_or(c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')) bad
    from customer group by 1)
  select status, count(*) n, count(attempt) n_stamped from (select case when bad then 'failed' else 'ok' end status,
    case when bad then '20250101' end attempt from customer join r on r.batch = c_custkey // 4) group by 1""")
def write_validated(spark, d):
    rows = v.table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 4).alias("batch"), F.col("c_custkey").alias("request"), F.col("c_mktsegment").alias("segment"))
    report = records.validate_batch(rows, rows, "batch", "request", {"segment": SEGMENTS})
    path = new_path(spark, "responses")
    records.write_validated(rows, report, "batch", path, "20250101")
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.count("attempt").alias("n_stamped"))


@query("rec03_three_valued_filter", """select c_custkey::int species_id, (c_custkey % 3 = 0 or c_custkey % 5 = 0 or c_custkey % 7 = 0) rejected
  from customer where c_custkey % 11 <> 0""")
def three_valued(spark, d):
    rows = records.parse_structured(answers(spark, d), ["request"], "text", records.FILTER_SCHEMA).where("not is_corrupt")
    out = records.three_valued_filter(rows, ["filter_is_quadrat_relevant", "filter_is_in_europe", "filter_is_in_pyrenees_med"])
    return out.select("species_id", "rejected")


@query("rec04_candidates_by_habitat", """with h as (select c_custkey, unnest([c_nationkey, (c_nationkey + 5) % 25]) h from customer),
  s as (select s_suppkey, unnest([s_nationkey, (s_nationkey + 1) % 25]) h from supplier)
  select c_custkey plot, count(distinct s_suppkey) n, sum(distinct s_suppkey)::bigint total from h join s using (h) group by 1""")
def candidates(spark, d):
    plots, species = habitat_tables(spark, d)
    measures = [F.count("*").alias("n"), F.sum("s_suppkey").alias("total")]
    return records.candidates_by_habitat(plots, species, "plot", "s_suppkey", "habitats", measures)


def habitat_tables(spark, d):
    plots = v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("plot"), F.array("c_nationkey", (F.col("c_nationkey") + 5) % 25).alias("habitats"))
    species = v.table(spark, d, "supplier").select("s_suppkey", F.array("s_nationkey", (F.col("s_nationkey") + 1) % 25).alias("habitats"))
    return plots, species


@query("rec04_candidates_by_habitat_set", """with p as (select list_sort([c_nationkey, (c_nationkey + 5) % 25]) hs, count(*) plots from customer group by 1),
  sets as (select row_number() over (order by hs) - 1 set_id, * from p),
  h as (select set_id, plots, unnest(hs) h from sets),
  s as (select s_suppkey, unnest([s_nationkey, (s_nationkey + 1) % 25]) h from supplier)
  select set_id, plots, count(distinct s_suppkey) n, coalesce(sum(distinct s_suppkey), 0)::bigint total
  from h left join s using (h) group by all""")
def candidate_sets(spark, d):
    plots, species = habitat_tables(spark, d)
    sets, members = records.habitat_sets(plots, "plot", "habitats")
    found = records.candidates_by_set(sets, species, "s_suppkey", "habitats")
    of_set = found.groupBy("set_id").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total"))
    counted = members.groupBy("set_id").agg(F.count("*").alias("plots"))
    return counted.join(of_set, "set_id", "left").fillna(0, ["n", "total"])


@query("rec05_missing_batches", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_batches(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id")
    return records.missing_batches(docs, v.table(spark, d, "labels"), "doc_id")


@query("rec05_attempt_summary", """select state, count(*) n from (select d.doc_id, case when max(quality) = 1 then 'success'
  when max(quality) = 0 then 'failed' else 'skipped' end state from documents d left join labels l using (doc_id) group by 1) group by 1""")
def attempt_summary(spark, d):
    tried = v.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return records.attempt_summary(v.table(spark, d, "documents"), tried, "doc_id")


@query("str17_parse_record_blocks", """select n_name file, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int block,
  s_suppkey::varchar species_id, s_name scientific_name, case when s_suppkey % 2 = 0 then 'seen: ' || s_acctbal::varchar end justification
  from supplier join nation on n_nationkey = s_nationkey""")
def record_blocks(spark, d):
    s = v.table(spark, d, "supplier").join(v.table(spark, d, "nation"), F.expr("n_nationkey = s_nationkey"))
    note = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("justification: seen: "), F.col("s_acctbal").cast("string"), F.lit("\n"))).otherwise("")
    block = F.concat(F.lit("---\nspecies_id: "), F.col("s_suppkey").cast("string"), F.lit("\nscientific_name: "), "s_name", F.lit("\n"), note)
    files = s.groupBy(F.col("n_name").alias("file")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))).alias("bs"))
    text = files.select("file", F.array_join(F.transform("bs", lambda e: e["b"]), "\n").alias("text"))
    return records.parse_record_blocks(text, ["file"], "text", ["species_id", "scientific_name", "justification"])


# ------------------------------------------------------------------------------------ telemetry


def write_log(spark, d, path):
    """A GPU log with one document per event; processes come as an object or as an array."""
    process = F.struct(
        (F.col("user_id") % 20).cast("string").alias("pid"), F.lit("python").alias("process_name"), F.lit("C").alias("type"),
        F.concat(F.floor("value").cast("string"), F.lit(" MiB")).alias("used_memory"))
    gpu = F.struct(
        F.lit("GPU").alias("product_name"),
        F.struct(F.concat((F.col("user_id") % 101).cast("string"), F.lit(" %")).alias("gpu_util"),
                 F.concat((F.col("event_id") % 101).cast("string"), F.lit(" %")).alias("memory_util")).alias("utilization"),
        F.struct(F.lit("@").alias("process_info")).alias("processes"))
    log = F.to_json(F.struct(F.struct(
        F.date_format("ts", "E MMM dd HH:mm:ss yyyy").alias("timestamp"), gpu.alias("gpu")).alias("nvidia_smi_log")))
    listed = F.when(F.col("event_id") % 2 == 0, F.to_json(process)).otherwise(F.to_json(F.array(process)))
    v.table(spark, d, "events").select(F.replace(log, F.lit('"@"'), listed)).write.text(path)


def log(spark, d):
    path = new_path(spark, "log")
    write_log(spark, d, path)
    return readers.scan_telemetry(spark, path)


@query("src08_scan_telemetry", """select floor(epoch(ts))::bigint "timestamp", 'GPU' product_name, (user_id % 101) || ' %' gpu_util,
  (event_id % 101) || ' %' memory_util from events""")
def scan_telemetry(spark, d):
    return telemetry.newest_first(log(spark, d)).select("timestamp", "product_name", "utilization.gpu_util", "utilization.memory_util")


@query("agg29_process_usage", """with e as (select floor(epoch(ts))::bigint t, (user_id % 20)::varchar pid, floor(value)::int m from events)
  select pid, min(t) "start", max(t) "end", count(t) interval_count, min(m) min_used_memory_mb, max(m) max_used_memory_mb,
  round(avg(m), 6) avg_used_memory_mb, round(stddev(m), 6) stddev_used_memory_mb, max(t) - min(t) duration_sec from e group by pid""")
def process_usage(spark, d):
    out = telemetry.process_usage(readers.process_rows(log(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_used_memory_mb", "stddev_used_memory_mb")})


@query("agg30_utilisation_series", """with e as (select floor(epoch(ts))::bigint t, user_id, event_id from events)
  select round((t - min(t) over ()) / 60, 6) elapsed_minutes, t "timestamp", (user_id % 101)::int gpu_util, (event_id % 101)::int memory_util from e""")
def utilisation(spark, d):
    return telemetry.utilisation_series(log(spark, d)).withColumn("elapsed_minutes", F.round("elapsed_minutes", 6))


@query("ext01_stream_files", "select 's_suppkey=' || s_suppkey folder, s_name text from supplier")
def stream_files(spark, d):
    source, out, state = (new_path(spark, x) for x in ("drop", "ingested", "state"))
    v.write_folders(spark, d, source)
    run = feeds.ingest_files(feeds.stream_files(spark, source, "*.txt"), out, state, 4)
    run.awaitTermination()
    got = spark.read.parquet(out)
    return got.select(F.element_at(F.split("path", "/"), -2).alias("folder"),
                      F.rtrim(F.col("data").cast("string"), F.lit("\n")).alias("text"))


@query("ext02_windowed_usage", """with e as (select floor(epoch(ts))::bigint t, (user_id % 20)::varchar pid, floor(value)::int m from events),
  w as (select t // 3600 * 3600 t0, pid, count(*) n, min(m) lo, max(m) hi, avg(m) mean from e group by all)
  select t0 started, pid, n interval_count, lo min_used_memory_mb, hi max_used_memory_mb, round(mean, 6) avg_used_memory_mb from w""")
def windowed_usage(spark, d):
    """The windows of a finished log, computed by the batch form of the stream."""
    out = feeds.windowed_usage(log(spark, d), "1 hour")
    return out.select(F.unix_timestamp("start").alias("started"), "pid", "interval_count", "min_used_memory_mb",
                      "max_used_memory_mb", F.round("avg_used_memory_mb", 6).alias("avg_used_memory_mb"))


@query("ext02_stream_windowed_usage", """with e as (select floor(epoch(ts))::bigint t, (user_id % 20)::varchar pid from events),
  mark as (select max(t) - 300 m from e)
  select t // 3600 * 3600 started, pid, count(*) interval_count from e, mark where t // 3600 * 3600 + 3600 <= m group by all""")
def stream_windowed_usage(spark, d):
    """Windows that the watermark has closed when the log ends."""
    source, out, state = (new_path(spark, x) for x in ("log", "windows", "state"))
    write_log(spark, d, source)
    run = feeds.write_windows(feeds.windowed_usage(feeds.stream_telemetry(spark, source), "1 hour"), out, state)
    run.awaitTermination()
    return spark.read.parquet(out).select(F.unix_timestamp("start").alias("started"), "pid", "interval_count")
