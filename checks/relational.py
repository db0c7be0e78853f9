"""Joins, aggregates, windows, rankings and set operators."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from tileflow.functions import lists
from tileflow.functions.names import base_plot_id, region_of
from tileflow.operators import counting, joins, label_lists as ll, numbering
from tileflow.plans import submission
from tileflow.sources.tables import settle

from checks.shaping import COUNTRIES, PLOT_SQL, REGION_SQL, occurrences


def joined(col):
    """A list as text, so that the comparison sees scalars."""
    return F.array_join(col.cast("array<string>"), ",")


# ---------------------------------------------------------------------------------------- joins


@query("jon01_join_metadata", f"""with {v.OBS} select o.l_orderkey, o.l_linenumber, o.l_extendedprice, obs.species_id, obs.genus
  from lineitem o join (select * from (select *, row_number() over (partition by image_name order by species_id, genus) r
    from obs) where r = 1) obs on obs.image_name = concat(o.l_orderkey, '-', o.l_linenumber, '.jpg')""")
def join_metadata(spark, d):
    name = F.concat(v.text(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")), F.lit(".jpg"))
    images = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", name.alias("image_name"))
    meta = v.obs(spark, d).select("image_name", "species_id", "genus")
    return joins.join_metadata(images, meta.unionAll(meta)).drop("image_name")


TOP5 = "top as (select species_id from obs group by 1 order by count(*) desc, species_id limit 5)"


@query("jon02_join_topn", f"with {v.OBS}, {TOP5} select image_name, species_id from obs where species_id in (select species_id from top)")
def join_topn(spark, d):
    o = v.obs(spark, d)
    return joins.join_top_groups(o, counting.top_n_groups(o, ["species_id"], 5)).select("image_name", "species_id")


@query("jon03_join_labels", """select d.doc_id, d.lang, l.quality, l.toxic from documents d join labels l using (doc_id)""")
def join_labels(spark, d):
    return joins.join_labels(
        v.table(spark, d, "documents").select("doc_id", "lang"), v.table(spark, d, "labels"), "doc_id", ["quality", "toxic"])


@query("jon05_join_multi_key", """select a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax from lineitem a
  join (select l_orderkey, l_linenumber, l_tax from lineitem where l_returnflag <> 'N') b using (l_orderkey, l_linenumber)""")
def join_multi_key(spark, d):
    line = v.table(spark, d, "lineitem")
    a = line.select("l_orderkey", "l_linenumber", "l_quantity")
    b = line.where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_tax")
    return joins.join_multi_key(a, b, ["l_orderkey", "l_linenumber"])


FILL = f"""with {v.PRED}, {v.list_sql("a", "in_a and in_b and pos > 2")}
  select p.quadrat_id, coalesce(array_to_string(species_ids, ','), '') species_ids
  from (select distinct quadrat_id from plot_name) p left join a using (quadrat_id)"""


@query("jon07_left_join_fill_empty", FILL)
def left_join_fill(spark, d):
    preds = v.pred_lists(spark, d, "in_a and in_b and pos > 2")
    out = joins.left_join_fill_empty(v.plots(spark, d), preds, "quadrat_id")
    return out.withColumn("species_ids", joined(F.col("species_ids")))


@query("jon08_outer_join_fill_empty", f"""with {v.PRED}, {v.list_sql("a", "in_b and pos > 2")},
  ids as (select distinct quadrat_id from pred where in_a)
  select coalesce(p.quadrat_id, a.quadrat_id) quadrat_id, coalesce(array_to_string(species_ids, ','), '') species_ids
  from ids p full join a on p.quadrat_id = a.quadrat_id""")
def outer_join_fill(spark, d):
    preds = v.pred_lists(spark, d, "in_b and pos > 2")
    ids = v.pred_rows(spark, d).where("in_a")
    out = joins.outer_join_fill_empty(ids, preds, "quadrat_id")
    return out.withColumn("species_ids", joined(F.col("species_ids")))


@query("jon09_join_back_group", """select l_orderkey, l_linenumber, max(l_extendedprice) over (partition by l_orderkey) best from lineitem""")
def join_back(spark, d):
    line = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    best = line.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"))
    return joins.join_back_group(line, best, ["l_orderkey"]).drop("l_extendedprice")


AB = f"""with {v.PRED}, {v.list_sql("a", "in_a")}, {v.list_sql("b", "in_b")},
  j as (select coalesce(a.quadrat_id, b.quadrat_id) quadrat_id, a.species_ids la, b.species_ids lb,
    coalesce(list_distinct(a.species_ids), []) sa, coalesce(list_distinct(b.species_ids), []) sb
    from a full join b on a.quadrat_id = b.quadrat_id),
  s as (select quadrat_id, sa, sb, list_sort(list_intersect(sa, sb)) common, list_sort(list_distinct(list_concat(sa, sb))) every
    from j),
  sj as (select *, case when len(every) = 0 then 0 else len(common)::double / len(every) end score from s)"""


def pairs(spark, d):
    return joins.join_outer_pairs(v.pred_lists(spark, d, "in_a"), v.pred_lists(spark, d, "in_b"), "quadrat_id")


@query("jon10_join_outer_pairs", AB + """ select quadrat_id, array_to_string(la, ',') species_ids_a,
  array_to_string(lb, ',') species_ids_b from j""")
def outer_pairs(spark, d):
    return pairs(spark, d).select("quadrat_id", *[joined(F.col(c)).alias(c) for c in ("species_ids_a", "species_ids_b")])


def indicator(only_diff):
    def run(spark, d):
        rows = v.pred_rows(spark, d)
        cols = ["quadrat_id", "species_id"]
        return joins.join_indicator_diff(
            rows.where("in_a").select(*cols).distinct(), rows.where("in_b").select(*cols).distinct(), cols, only_diff)

    return run


DIFF = f"""with {v.PRED}, a as (select distinct quadrat_id, species_id from pred where in_a),
  b as (select distinct quadrat_id, species_id from pred where in_b),
  m as (select coalesce(a.quadrat_id, b.quadrat_id) quadrat_id, coalesce(a.species_id, b.species_id) species_id,
    case when b.species_id is null then 'left_only' when a.species_id is null then 'right_only' else 'both' end _merge
    from a full join b on a.quadrat_id = b.quadrat_id and a.species_id = b.species_id) select * from m"""
query("jon11_join_indicator", DIFF)(indicator(False))
query("jon11_join_indicator_diff", DIFF + " where _merge <> 'both'")(indicator(True))


@query("jon13_map_lookup_default", """select p_partkey, p_type, coalesce(n, 0) n from part left join (
  select p_type, count(*) n from part where p_size > 25 group by 1 having count(*) > 2) using (p_type)""")
def map_lookup(spark, d):
    part = v.table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    counts = part.where("p_size > 25").groupBy("p_type").agg(F.count("*").alias("n")).where("n > 2")
    return joins.map_lookup_default(part, counts, "p_type", "n").drop("p_size")


ALLOWED = "allowed as (select s_suppkey from supplier where s_acctbal > 3000)"
KEPT = f"""with {v.PRED}, {ALLOWED}
  select quadrat_id, coalesce(string_agg(species_id::varchar, ',' order by visit, pos, species_id)
    filter (where species_id in (select s_suppkey from allowed)), '') species_ids from pred group by quadrat_id"""


def allowed(spark, d):
    return v.table(spark, d, "supplier").where("s_acctbal > 3000").select("s_suppkey")


@query("jon14_keep_allowed_elements", KEPT)
def keep_allowed(spark, d):
    out = joins.keep_allowed_elements(settle(v.pred_lists(spark, d)), allowed(spark, d))
    return out.select("quadrat_id", joined(F.col("species_ids")).alias("species_ids"))


@query("jon15_join_species_metadata", COUNTRIES + """select n.species, country, n n_seen, s_acctbal from n
  left join (select s_name species, s_acctbal from supplier where s_acctbal > 0) m using (species) where country = 'NATION_3'""")
def join_species(spark, d):
    counts = occurrences(spark, d).where("country = 'NATION_3'").groupBy("species", "country").agg(F.count("*").alias("n_seen"))
    meta = v.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("species"), "s_acctbal")
    return joins.join_species_metadata(counts, meta)


@query("jon19_attach_cluster", """select l_orderkey, l_linenumber, s_nationkey from lineitem join supplier on s_suppkey = l_suppkey""")
def attach_cluster(spark, d):
    labels = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    line = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.attach_cluster(line, labels, "l_suppkey").drop("l_suppkey")


# ----------------------------------------------------------------------------------- aggregates


@query("agg01_count_by_species", f"with {v.OBS} select species, species_id, count(*) n from obs group by all")
def count_by_species(spark, d):
    return counting.count_by(v.obs(spark, d), ["species", "species_id"])


@query("agg02_count_by_category", f"with {v.OBS} select organ, count(*) n from obs group by 1")
def count_by_category(spark, d):
    return counting.count_by(v.obs(spark, d), ["organ"])


def stats_sql(key):
    return f"""with {v.OBS} select {key}, round(avg(altitude), 6) mean, round(stddev(altitude), 6) std, count(altitude) n
      from obs group by {key}"""


def stats_job(key):
    return lambda spark, d: counting.taxon_stats(v.obs(spark, d), [key], "altitude").withColumns(
        {c: F.round(c, 6) for c in ("mean", "std")})


for _key in ("species", "genus", "family"):
    query(f"agg03_{_key}_altitude_stats", stats_sql(_key))(stats_job(_key))


@query("agg03_taxon_means", f"""with {v.OBS} select species_id, round(avg(altitude), 6) mean_altitude,
  round(avg(latitude), 6) mean_latitude, round(avg(longitude), 6) mean_longitude from obs group by 1""")
def taxon_means(spark, d):
    out = counting.taxon_means(v.obs(spark, d), ["species_id"], ["altitude", "latitude", "longitude"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "species_id"})


@query("agg04_null_ratio_profile", f"""with {v.OBS} select round(avg((altitude is null)::int), 6) altitude_null_ratio,
  round(avg((longitude is null)::int), 6) longitude_null_ratio,
  round(avg((altitude is null and longitude is null)::int), 6) joint_null_ratio from obs""")
def null_ratio(spark, d):
    out = counting.null_ratio_profile(v.obs(spark, d), ["altitude", "longitude"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query("agg05_nonnull_profile", f"""with {v.OBS}, c as (select count(image_name) image_name, count(altitude) altitude,
  count(longitude) longitude from obs) unpivot c on image_name, altitude, longitude into name "column" value non_null""")
def nonnull(spark, d):
    return counting.nonnull_profile(v.obs(spark, d).select("image_name", "altitude", "longitude"))


@query("agg06_describe_cols", """select count(l_quantity) l_quantity_count, round(avg(l_quantity), 6) l_quantity_mean,
  round(stddev(l_quantity), 6) l_quantity_std, min(l_quantity) l_quantity_min, max(l_quantity) l_quantity_max,
  quantile_disc(l_quantity, 0.25) l_quantity_p25, quantile_disc(l_quantity, 0.5) l_quantity_p50,
  quantile_disc(l_quantity, 0.75) l_quantity_p75 from lineitem""")
def describe(spark, d):
    out = counting.describe_cols(v.table(spark, d, "lineitem"), ["l_quantity"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity_mean", "l_quantity_std")})


@query("agg07_nunique_per_group", f"with {v.OBS} select genus, count(distinct species) n_items from obs group by 1")
def nunique(spark, d):
    return counting.nunique_per_group(v.obs(spark, d), "genus", "species")


@query("agg07_mean_nunique", f"""with {v.OBS}, n as (select family, count(distinct species) n from obs group by 1)
  select count(*) n_groups, round(avg(n), 6) mean_items from n""")
def mean_nunique(spark, d):
    return counting.mean_nunique(v.obs(spark, d), "family", "species").withColumn("mean_items", F.round("mean_items", 6))


@query("agg10_whisker_stats", """select l_linenumber, count(l_extendedprice) price_count, round(avg(l_extendedprice), 4) price_mean,
  round(stddev(l_extendedprice), 4) price_std, min(l_extendedprice) price_min, max(l_extendedprice) price_max,
  quantile_disc(l_extendedprice, 0.05) price_p5, quantile_disc(l_extendedprice, 0.25) price_p25,
  quantile_disc(l_extendedprice, 0.5) price_p50, quantile_disc(l_extendedprice, 0.75) price_p75,
  quantile_disc(l_extendedprice, 0.95) price_p95 from lineitem group by 1""")
def whisker(spark, d):
    line = v.table(spark, d, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("price"))
    out = counting.whisker_stats(line, ["l_linenumber"], ["price"])
    return out.withColumns({c: F.round(c, 4) for c in ("price_mean", "price_std")})


BASED = f"with {v.PRED}, based as (select *, {PLOT_SQL} base from pred)"


def based(spark, d):
    return v.pred_rows(spark, d).withColumn("base", base_plot_id(F.col("quadrat_id")))


@query("agg11_list_union_distinct", BASED + """ select base, string_agg(species_id::varchar, ',' order by species_id) species_ids
  from (select distinct base, species_id from based) group by 1""")
def union_distinct(spark, d):
    return ll.list_union_distinct(based(spark, d), "base", "species_id").withColumn("species_ids", joined(F.col("species_ids")))


FREQ = BASED + """, seen as (select base, species_id, count(*) votes, min((quadrat_id, visit, pos)) s from based group by 1, 2),
  ranked as (select base, species_id, votes, row_number() over (partition by base order by votes desc, s, species_id) rank from seen)
  select * from ranked"""
ORDER = ["quadrat_id", "visit", "pos"]


@query("agg12_list_union_by_freq", FREQ)
def union_by_freq(spark, d):
    return ll.list_union_by_freq(based(spark, d), "base", "species_id", ORDER)


@query("agg13_list_union_topk", FREQ + " where rank <= 5")
def union_topk(spark, d):
    return ll.list_union_by_freq(based(spark, d), "base", "species_id", ORDER, k=5)


@query("agg13_aggregate_visits", f"""with {v.PRED}, {v.list_sql("p")}, u as (select quadrat_id, {PLOT_SQL} base,
  unnest(species_ids) species_id, generate_subscripts(species_ids, 1) pos from p),
  s as (select base, species_id, count(*) votes, min((quadrat_id, pos)) s from u group by 1, 2),
  r as (select base, species_id, row_number() over (partition by base order by votes desc, s, species_id) rank from s),
  l as (select base, string_agg(species_id::varchar, ',' order by rank) species_ids from r where rank <= 10 group by 1)
  select quadrat_id, l.species_ids from (select quadrat_id, {PLOT_SQL} base from p) q join l using (base)""")
def aggregate_visits(spark, d):
    out = submission.aggregate_visits(settle(v.pred_lists(spark, d)), k=10)
    return out.withColumn("species_ids", joined(F.col("species_ids")))


@query("agg14_vote_topk", f"""with {v.PRED}, b as (select * from (select *, row_number() over (
  partition by quadrat_id, visit order by score desc, species_id) p from pred) where p <= 2),
  c as (select quadrat_id, species_id, count(*) votes from b group by all)
  select * from (select *, row_number() over (partition by quadrat_id order by votes desc, species_id) rank from c) where rank <= 3""")
def vote_topk(spark, d):
    return ll.vote_topk(v.pred_rows(spark, d), "quadrat_id", "visit", "species_id", "score", n=2, k=3)


REG = f"with {v.PRED}, reg as (select *, {REGION_SQL} region, (species_id % 5)::int cluster from pred)"


def regions(spark, d):
    rows = v.pred_rows(spark, d)
    return rows.withColumn("region", region_of(F.col("quadrat_id"))).withColumn(
        "cluster", (F.col("species_id") % 5).cast("int"))


@query("agg18_dominant_cluster", REG + """, c as (select region, cluster, count(*) n from reg group by all)
  select region, cluster dominant_cluster, n from (select *, row_number() over (partition by region order by n desc, cluster) r
  from c) where r = 1""")
def dominant(spark, d):
    return counting.dominant_cluster(regions(spark, d), "region", "cluster")


@query("agg19_crosstab_zero_filled", REG + " select region, " + ", ".join(
    f'count(*) filter (where cluster = {i}) "{i}"' for i in range(5)) + " from reg group by region")
def crosstab(spark, d):
    return counting.crosstab_zero_filled(regions(spark, d), "region", "cluster", range(5))


@query("agg20_group_list", REG + """ select cluster, string_agg(region, ',' order by region) items
  from (select distinct cluster, region from reg) group by 1""")
def group_list(spark, d):
    return counting.group_list(regions(spark, d), "cluster", "region").withColumn("items", F.array_join("items", ","))


@query("agg20_group_list_chunks", REG + """, d as (select distinct region, quadrat_id from reg where quadrat_id is not null),
  n as (select *, (row_number() over (partition by region order by quadrat_id) - 1) // 7 chunk from d)
  select region, chunk, string_agg(quadrat_id, ',' order by quadrat_id) items from n group by 1, 2""")
def group_list_chunks(spark, d):
    out = counting.group_list_chunks(regions(spark, d), "region", "quadrat_id", size=7)
    return out.withColumn("items", F.array_join("items", ","))


@query("str07_unmatched_regions", REG + " select count(*) filter (where region = '') unmatched, count(*) \"rows\" from reg")
def unmatched(spark, d):
    return counting.unmatched_regions(regions(spark, d), "region")


@query("str07_region_counts", REG + " select region, count(*) n from reg group by 1")
def region_counts(spark, d):
    return counting.count_by(regions(spark, d), ["region"])


@query("agg21_group_size_stats", BASED + """, s as (select base, count(*) size from based group by 1)
  select count(*) n_groups, min(size) min_size, max(size) max_size, round(avg(size), 6) mean_size from s""")
def group_sizes(spark, d):
    return counting.group_size_stats(based(spark, d), "base").withColumn("mean_size", F.round("mean_size", 6))


@query("agg22_distinct_items_overall", f"with {v.PRED} select count(distinct species_id) n_items from pred")
def distinct_overall(spark, d):
    rows = ll.list_rows(v.pred_lists(spark, d), ["quadrat_id"])
    return ll.distinct_items_overall(rows, "species_id")


@query("agg23_list_size_stats", FILL.replace("select p.quadrat_id, coalesce(array_to_string(species_ids, ','), '') species_ids",
       """select count(*) n_lists, round(avg(coalesce(len(species_ids), 0)), 6) mean_size,
       round(avg((species_ids is null)::int), 6) empty_share"""))
def list_sizes(spark, d):
    preds = v.pred_lists(spark, d, "in_a and in_b and pos > 2")
    out = ll.list_size_stats(joins.left_join_fill_empty(v.plots(spark, d), preds, "quadrat_id"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_size", "empty_share")})


@query("agg24_filter_impact_report", f"""with {v.PRED}, {ALLOWED}, n as (select quadrat_id, count(*) b,
  count(*) filter (where species_id in (select s_suppkey from allowed)) a from pred group by 1)
  select sum(b)::bigint total_before, round(avg(b), 6) mean_before, min(b) min_before, max(b) max_before, sum(a)::bigint total_after,
  round(avg(a), 6) mean_after, min(a) min_after, max(a) max_after, sum(b - a)::bigint removed, round(sum(b - a) / sum(b), 6) reduction from n""")
def filter_impact(spark, d):
    before = settle(v.pred_lists(spark, d))
    out = ll.filter_impact_report(before, submission.filter_by_area(before, allowed(spark, d)), "quadrat_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after", "reduction")})


def nullable_occurrences(spark, d):
    return occurrences(spark, d).withColumn("country", F.when(F.col("country") != "NATION_1", F.col("country")))


UNKNOWN = COUNTRIES + ", u as (select species, case when country = 'NATION_1' then 'Unknown' else country end country, n from n) "


@query("agg25_country_counts", UNKNOWN + 'select species, country, n "count" from u')
def country_counts(spark, d):
    return counting.country_counts(nullable_occurrences(spark, d))


@query("agg26_country_rollup", UNKNOWN + """select species, string_agg(country, ',' order by country) countries,
  count(*) n_countries, sum(n)::bigint total_count from u group by 1""")
def country_rollup(spark, d):
    rollup = counting.country_rollup(counting.country_counts(nullable_occurrences(spark, d)))
    return rollup.withColumn("countries", F.array_join("countries", ","))


@query("agg26_present_in", UNKNOWN + """select count(distinct species) filter (where country = 'NATION_7') n_species,
  count(distinct species) n_all from u""")
def present_in(spark, d):
    return counting.present_in(counting.country_rollup(counting.country_counts(nullable_occurrences(spark, d))), "NATION_7")


STEPS = [0.1, 0.2, 0.3, 0.5, 0.8]


@query("agg31_jaccard_by_threshold", AB + """ select t threshold, round(coalesce(avg(score) filter (where score >= t), 0), 6) mean_jaccard
  from sj, unnest([0.1, 0.2, 0.3, 0.5, 0.8]::double[]) u(t) group by t""")
def jaccard_by_threshold(spark, d):
    out = ll.jaccard_by_threshold(pairs(spark, d), "species_ids_a", "species_ids_b", STEPS)
    return out.withColumn("mean_jaccard", F.round("mean_jaccard", 6))


PICK = """case when len(sa) = 0 or len(sb) = 0 or score >= {t} then every when len(common) > 0 then common
  else list_sort(sa) end"""


@query("agg32_distinct_by_threshold", AB + f""" select t threshold, count(distinct item) n_species from (
  select t, unnest({PICK.format(t="t")}) item from sj, unnest([0.1, 0.2, 0.3, 0.5, 0.8]::double[]) u(t)) group by t""")
def distinct_by_threshold(spark, d):
    return ll.distinct_by_threshold(pairs(spark, d), "species_ids_a", "species_ids_b", STEPS)


# ------------------------------------------------------------------------------ set operators


def set_job(make, as_text=True):
    def run(spark, d):
        a, b = F.col("species_ids_a"), F.col("species_ids_b")
        out = make(a, b)
        return pairs(spark, d).select("quadrat_id", (joined(out) if as_text else out).alias("value"))

    return run


query("set01_ensemble_union", AB + """ select quadrat_id, array_to_string(every, ',') "value" from s""")(set_job(lists.union_ids))


@query("set02_ensemble_intersect", AB + """ select quadrat_id, array_to_string(common, ',') "value" from s
  where len(sa) > 0 and len(sb) > 0""")
def ensemble_intersect(spark, d):
    a, b = v.pred_lists(spark, d, "in_a"), v.pred_lists(spark, d, "in_b")
    both = a.join(b.withColumnRenamed("species_ids", "other"), "quadrat_id")
    return both.select("quadrat_id", joined(lists.intersect_ids(F.col("species_ids"), F.col("other"))).alias("value"))


query("set03_ensemble_jaccard", AB + f""" select quadrat_id, array_to_string({PICK.format(t=0.3)}, ',') "value" from sj""")(
    set_job(lambda a, b: lists.jaccard_pick(a, b, 0.3)))
query("set04_jaccard_score", AB + ' select quadrat_id, round(score, 6) "value" from sj')(
    set_job(lambda a, b: F.round(lists.jaccard(a, b), 6), False))
query("set05_same_key_set", AB + ' select quadrat_id, list_sort(sa) = list_sort(sb) "value" from s')(
    set_job(lists.same_ids, False))


# ------------------------------------------------------------------------- windows and rankings


@query("win01_dense_row_id", """select row_number() over (order by l_orderkey, l_linenumber, l_partkey) - 1 id,
  l_orderkey, l_linenumber, l_partkey from lineitem""")
def dense_row_id(spark, d):
    line = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return numbering.dense_row_id(line, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("win02_stratified_sample", """select doc_id, source from (select doc_id, source, row_number() over (
  partition by source order by md5(doc_id::varchar), doc_id) r from documents) where r <= 5""")
def stratified(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "source")
    return numbering.stratified_sample(docs, "source", 5, order=[F.md5(F.col("doc_id").cast("string")), "doc_id"])


@query("win02_stratified_sample_random", "select source, least(count(*), 5) n from documents group by 1")
def stratified_random(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "source")
    return numbering.stratified_sample(docs, "source", 5, seed=3).groupBy("source").agg(F.count_distinct("doc_id").alias("n"))


@query("win05_row_number_by_key", """select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) row_number
  from events""")
def row_number_by_key(spark, d):
    events = v.table(spark, d, "events").select("event_id", "user_id", "ts")
    return numbering.row_number_by_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("top01_top_n_groups", f"with {v.OBS} select species_id, count(*) n from obs group by 1 order by n desc, species_id limit 20")
def top_n_groups(spark, d):
    return counting.top_n_groups(v.obs(spark, d), ["species_id"], 20)


@query("top02_naive_baseline", f"""with {v.OBS}, t as (select species_id, count(*) n from obs group by 1 order by n desc, species_id limit 8),
  l as (select string_agg(species_id::varchar, ',' order by n desc, species_id) species_ids from t)
  select distinct image_name, species_ids from tile_names, l""".replace("tile_names", "(select concat('img', vec_id // 16, '.jpg') image_name from embeddings)"))
def naive(spark, d):
    out = counting.naive_baseline(v.obs(spark, d), v.tiles(spark, d), 8)
    return out.withColumn("species_ids", joined(F.col("species_ids")))


@query("top06_order_by_keys", "select image_name, tile, vec_id from (select concat('img', vec_id // 16, '.jpg') image_name, (vec_id % 16)::int tile, vec_id from embeddings) order by 1, 2")
def order_by_keys(spark, d):
    return v.tiles(spark, d).select("image_name", "tile", "vec_id").orderBy("image_name", "tile")


@query("top07_tail_n", f"with {v.OBS} select species_id, count(*) n from obs group by 1 order by n, species_id desc limit 10")
def tail_n(spark, d):
    return counting.rarest_groups(v.obs(spark, d), ["species_id"], 10)


@query("ml15_taxon_shrinkage", f"""with {v.OBS}, sp as (select family, genus, species, coalesce(sum(altitude), 0) s, count(altitude) n
    from obs group by all), ge as (select family, genus, sum(s) gs, sum(n) gn from sp group by all),
  fa as (select family, sum(gs) / sum(gn) fm from ge group by all),
  gi as (select genus, family, (gs + 10 * fm) / (gn + 10) g from ge join fa using (family))
  select species, genus, family, n, round((s + 10 * g) / (n + 10), 6) estimate from sp join gi using (family, genus)""")
def shrinkage(spark, d):
    out = counting.taxon_shrinkage(v.obs(spark, d), "species", "genus", "family", "altitude")
    return out.withColumn("estimate", F.round("estimate", 6))
