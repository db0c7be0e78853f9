"""Filters, projections, sampling, string and source/sink queries."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from tileflow.functions import lists, names
from tileflow.operators import numbering, shaping
from tileflow.sources import readers, writers
from tileflow.sources.tables import new_path

# ---------------------------------------------------------------------------------- projections


@query("prj01_filter_eq", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R'")
def filter_eq(spark, d):
    line = v.table(spark, d, "lineitem")
    return shaping.filter_eq(line, "l_returnflag", "R").select("l_orderkey", "l_linenumber", "l_quantity")


@query("prj02_filter_isin", "select event_id, user_id from events where event_type in ('click', 'error')")
def filter_isin(spark, d):
    return shaping.filter_isin(v.table(spark, d, "events"), "event_type", ["click", "error"]).select("event_id", "user_id")


@query("prj02_filter_isin_table", """select l_orderkey, l_linenumber from lineitem
  where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000)""")
def filter_isin_table(spark, d):
    rich = v.table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey")
    return shaping.filter_isin(v.table(spark, d, "lineitem"), "l_suppkey", rich).select("l_orderkey", "l_linenumber")


@query("prj03_filter_between", "select o_orderkey, o_totalprice from orders where o_totalprice between 50000 and 150000")
def filter_between(spark, d):
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return shaping.filter_between(orders, "o_totalprice", 50000, 150000)


@query("prj04_filter_min_count", """select l_suppkey, count(*) n from lineitem group by 1 having count(*) >= 600""")
def filter_min_count(spark, d):
    return shaping.filter_min_count(v.table(spark, d, "lineitem"), "l_suppkey", 600)


@query("prj05_limit_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def limit_rows(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return shaping.limit_rows(o, [F.desc("o_totalprice"), "o_orderkey"], 50)


def lots(seed, rest):
    number = f"('0x' || substr(md5('{seed}-' || doc_id), 1, 8))::bigint"
    return f"select doc_id, lang from (select *, {number} lot from documents) {rest}"


@query("prj06_sample_fraction", lots(42, f"where lot < {int(0.1 * 2**32)} order by lot, doc_id limit 1000"))
def sample_fraction(spark, d):
    return shaping.sample_fraction(v.table(spark, d, "documents").select("doc_id", "lang"), 0.1, 42, ["doc_id"], cap=1000)


@query("prj07_random_rows", lots(7, "order by lot, doc_id limit 20"))
def random_rows(spark, d):
    return shaping.random_rows(v.table(spark, d, "documents").select("doc_id", "lang"), 20, 7, ["doc_id"])


@query("prj08_hash_bucket", """select sample_id, count(*) n, sum(l_quantity) quantity from (
  select ('0x' || substr(md5(concat(l_orderkey, '-', l_linenumber, '.jpg')), 1, 8))::bigint % 10 sample_id, l_quantity
  from lineitem) group by 1""")
def hash_bucket(spark, d):
    name = F.concat(v.text(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")), F.lit(".jpg"))
    line = v.table(spark, d, "lineitem").select(
        shaping.hash_bucket(name, 10, "md5").alias("sample_id"), "l_quantity")
    return line.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::bigint)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, n: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


@query("prj08_hash_bucket_crc32", f"""select ({CRC32} % 20)::int sample_id, count(*) n from (select l_orderkey::varchar s from lineitem)
  group by 1""")
def hash_bucket_crc32(spark, d):
    line = v.table(spark, d, "lineitem").select(shaping.hash_bucket(F.col("l_orderkey"), 20).alias("sample_id"))
    return line.groupBy("sample_id").agg(F.count("*").alias("n"))


@query("prj09_mod_shard", "select o_orderkey % 7 shard, count(*) n, sum(o_totalprice) total from orders group by 1")
def mod_shard(spark, d):
    o = v.table(spark, d, "orders")
    parts = [shaping.mod_shard(o, "o_orderkey", 7, i).agg(
        F.any_value(F.lit(i)).alias("shard"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    ) for i in range(7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("prj10_fixed_batches", """select batch, count(*) n, min(o_orderkey) first, max(o_orderkey) last from (
  select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 10 batch from orders) group by 1""")
def fixed_batches(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey")
    return numbering.fixed_batches(o, ["o_orderkey"], 10).groupBy("batch").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("prj11_distinct_pairs", f"with {v.OBS} select distinct species_id, species from obs")
def distinct_pairs(spark, d):
    return shaping.distinct_pairs(v.obs(spark, d), ["species_id", "species"])


@query("prj12_dedup_by_key", """select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (
  partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) r from lineitem) where r = 1""")
def dedup_by_key(spark, d):
    line = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"]
    return shaping.dedup_by_key(line, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("prj13_unnest_struct", "select event_id, (props->>'k')::int k, event_type from events")
def unnest_struct(spark, d):
    e = v.table(spark, d, "events").select(
        "event_id", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").alias("output"))
    return shaping.unnest_struct(e, "output", ["event_id"])


@query("prj14_drop_rename", "select s_suppkey species_id, s_name species, s_nationkey from supplier")
def drop_rename(spark, d):
    return shaping.drop_rename(
        v.table(spark, d, "supplier"), ["s_acctbal"], {"s_suppkey": "species_id", "s_name": "species"},
        ["species", "species_id", "s_nationkey"])


@query("prj15_sql_stage", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) net from lineitem where l_tax > 0.05")
def sql_stage(spark, d):
    stage = shaping.sql_stage(
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM __THIS__ WHERE l_tax > 0.05")
    return stage.transform(v.table(spark, d, "lineitem"))


@query("prj16_vector_to_array_cols", """select vec_id, round(sum(x), 6) total, count(*) n from (
  select vec_id, unnest(embedding)::double x from embeddings) group by 1""")
def vector_to_array_cols(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("vector"))
    arrays = shaping.vector_to_array_cols(e, ["vector"])
    return arrays.select("vec_id", F.explode("vector").alias("x")).groupBy("vec_id").agg(
        F.round(F.sum("x"), 6).alias("total"), F.count("*").alias("n"))


@query("prj17_unpivot_by_name", """select l_orderkey, l_linenumber, mask_type, mask from (
  select l_orderkey, l_linenumber, l_quantity leaf_mask, l_extendedprice plant_mask, l_tax rock_mask from lineitem)
  unpivot (mask for mask_type in (leaf_mask, plant_mask, rock_mask))""")
def unpivot_by_name(spark, d):
    wide = v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("leaf_mask"),
        F.col("l_extendedprice").alias("plant_mask"), F.col("l_tax").alias("rock_mask"))
    return shaping.unpivot_by_name(wide, ["l_orderkey", "l_linenumber"], "mask", "mask_type", "mask")


# -------------------------------------------------------------------------------------- strings


@query("str01_relative_path", "select page_id, replace('file:/data/' || url, 'file:/data', '') path from pages")
def relative_path(spark, d):
    full = F.concat(F.lit("file:/data/"), F.col("url"))
    return v.table(spark, d, "pages").select("page_id", names.relative_path(full, "/data").alias("path"))


@query("str02_basename", "select page_id, string_split(url, '/')[-1] name from pages")
def basename(spark, d):
    return v.table(spark, d, "pages").select("page_id", names.basename(F.col("url")).alias("name"))


@query("str03_strip_ext_last", "select page_id, regexp_replace(url, '[.][^.]*$', '') name from pages")
def strip_ext_last(spark, d):
    return v.table(spark, d, "pages").select("page_id", names.strip_ext_last(F.col("url")).alias("name"))


@query("str04_strip_ext_first", "select page_id, split_part(url, '.', 1) name from pages")
def strip_ext_first(spark, d):
    return v.table(spark, d, "pages").select("page_id", names.strip_ext_first(F.col("url")).alias("name"))


@query("str05_strip_jpg_all", f"with {v.OBS} select image_name, replace(image_name, '.jpg', '') name from obs")
def strip_jpg_all(spark, d):
    return v.obs(spark, d).select("image_name", names.strip_jpg_all(F.col("image_name")).alias("name"))


REGION_SQL = "regexp_extract(quadrat_id, '^(" + "|".join(names.REGIONS) + ")', 1)"


@query("str06_region_of", f"with {v.PLOT} select o_orderkey, {REGION_SQL} region from plot_name")
def region_of(spark, d):
    return v.plots(spark, d).select("o_orderkey", names.region_of(F.col("quadrat_id")).alias("region"))


PLOT_SQL = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(quadrat_id, '{p}', 1), '')" for p in names.PLOT_PATTERNS) + ", quadrat_id)"


@query("str08_base_plot_id", f"with {v.PLOT} select o_orderkey, {PLOT_SQL} plot from plot_name")
def base_plot_id(spark, d):
    return v.plots(spark, d).select("o_orderkey", names.base_plot_id(F.col("quadrat_id")).alias("plot"))


@query("str09_filter_prefix", f"with {v.PLOT} select o_orderkey, quadrat_id from plot_name where quadrat_id like 'RNNB%'")
def filter_prefix(spark, d):
    return shaping.filter_prefix(v.plots(spark, d), "quadrat_id", "RNNB")


@query("str10_parse_id_list", f"with {v.PRED} select quadrat_id, species_id, count(*) n from pred group by all")
def parse_id_list(spark, d):
    text = writers.prediction_text(v.pred_lists(spark, d))
    ids = text.select("quadrat_id", F.explode(lists.parse_ids(F.col("species_ids"))).alias("species_id"))
    return ids.groupBy("quadrat_id", "species_id").agg(F.count("*").alias("n"))


@query("str11_format_id_list", f"""with {v.PRED} select quadrat_id,
  concat('[', string_agg(species_id::varchar, ', ' order by visit, pos, species_id), ']') species_ids
  from pred group by quadrat_id""")
def format_id_list(spark, d):
    return writers.prediction_text(v.pred_lists(spark, d))


@query("str12_slug", "select p_partkey, regexp_replace(replace(lower(p_name || ' ' || p_brand), ' ', '_'), '[^a-z0-9_]', '_', 'g') slug from part")
def slug(spark, d):
    return v.table(spark, d, "part").select("p_partkey", names.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("str13_label_text", """select event_id, upper(event_type[1]) || lower(event_type[2:]) || ' Mask' label from events""")
def label_text(spark, d):
    return v.table(spark, d, "events").select(
        "event_id", names.label_text(F.concat(F.col("event_type"), F.lit("_mask"))).alias("label"))


@query("str14_parse_unit_number", """select event_id, try_cast(split_part(floor(value)::bigint || ' MiB', ' ', 1) as int) mb,
  try_cast(split_part(event_type, ' ', 1) as int) none from events""")
def parse_unit_number(spark, d):
    mib = F.concat(F.floor("value").cast("string"), F.lit(" MiB"))
    return v.table(spark, d, "events").select(
        "event_id", names.unit_number(mib).alias("mb"), names.unit_number(F.col("event_type")).alias("none"))


@query("str15_parse_log_time", 'select event_id, floor(epoch(ts))::bigint "seconds" from events')
def parse_log_time(spark, d):
    text = F.date_format("ts", "E MMM dd HH:mm:ss yyyy")
    return v.table(spark, d, "events").select("event_id", names.log_time(text).alias("seconds"))


@query("str16_capture_date", f"""with {v.PLOT}, dated as (select o_orderkey,
    try_strptime(nullif(regexp_extract(quadrat_id, '-([0-9]{{8}})', 1), ''), '%Y%m%d')::date taken from plot_name)
  select o_orderkey, strftime(taken, '%Y-%m-%d') taken_on, case when month(taken) in (3, 4, 5) then 'Spring'
    when month(taken) in (6, 7, 8) then 'Summer' when month(taken) in (9, 10, 11) then 'Autumn'
    when taken is not null then 'Winter' end season from dated""")
def capture_date(spark, d):
    day = names.capture_date(F.col("quadrat_id"))
    return v.plots(spark, d).select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("taken_on"), names.season(day).alias("season"))


@query("str18_grid_label_to_n", """select l_linenumber || 'x' || l_linenumber grid, l_linenumber n, count(*) n_rows
  from lineitem group by all""")
def grid_label(spark, d):
    line = v.table(spark, d, "lineitem").withColumn("grid", names.n_to_grid(F.col("l_linenumber")))
    return line.groupBy("grid", names.grid_to_n(F.col("grid")).alias("n")).agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------------- sources and sinks


@query("src01_scan_binary_dir", "select 's_suppkey=' || s_suppkey folder, s_name text, length(s_name) + 1 bytes from supplier")
def scan_binary_dir(spark, d):
    path = new_path(spark, "files")
    v.write_folders(spark, d, path)
    files = readers.image_table(readers.scan_binary_dir(spark, path, "*.txt"), "/nowhere")
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.rtrim(F.col("data").cast("string"), F.lit("\n")).alias("text"), F.length("data").alias("bytes"))


META = "image_name string, species_id int, species string, genus string, family string, organ string, altitude double"


@query("src03_scan_metadata_csv", f"with {v.OBS} select image_name, species_id, species, genus, family, organ, altitude from obs")
def scan_metadata_csv(spark, d):
    path = new_path(spark, "meta")
    cols = [c.split()[0] for c in META.split(", ")]
    v.obs(spark, d).select(*cols).write.csv(path, header=True, sep=";")
    return readers.scan_metadata_csv(spark, path, META)


PRED_TEXT = f"""with {v.PRED} select quadrat_id,
  concat('[', string_agg(species_id::varchar, ', ' order by visit, pos, species_id), ']') species_ids
  from pred group by quadrat_id"""


def predictions_csv(style, sep):
    def run(spark, d):
        path = new_path(spark, "predictions")
        writers.write_predictions_csv(writers.prediction_text(v.pred_lists(spark, d)), path, style)
        return readers.scan_predictions_csv(spark, path, sep)

    return run


query("src04_snk05_predictions_csv_quoted", PRED_TEXT)(predictions_csv("quoted", ","))
query("src04_snk05_predictions_csv_plain", PRED_TEXT)(predictions_csv("plain", ";"))


@query("src05_snk03_scan_parquet_partitions", """select l_returnflag, l_orderkey, l_linenumber, l_quantity from lineitem
  where l_returnflag = 'A'""")
def scan_parquet(spark, d):
    path = new_path(spark, "grids")
    line = v.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    writers.write_bucketed_dirs(line, path, "l_returnflag")
    return readers.scan_parquet(spark, path).where("l_returnflag = 'A'")


@query("src06_scan_parquet_recursive", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def scan_parquet_recursive(spark, d):
    path = new_path(spark, "grids")
    line = v.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    writers.write_bucketed_dirs(line, path, "l_returnflag")
    return readers.scan_parquet_recursive(spark, path)


COUNTRIES = """with n as (select s_name species, n_name country, count(*) n from lineitem
  join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey group by all) """


def occurrences(spark, d):
    """Species seen in a country, one row per order line."""
    return (
        v.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
        .join(v.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("species")), F.expr("l_suppkey = s_suppkey"))
        .join(v.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
        .join(v.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        .join(v.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country")), F.expr("c_nationkey = n_nationkey"))
        .select("species", "country")
    )


@query("src07_scan_country_json", COUNTRIES + "select species, country, n \"count\" from n")
def scan_country_json(spark, d):
    counts = occurrences(spark, d).groupBy("species", "country").agg(F.count("*").alias("n"))
    inner = F.map_from_entries(F.collect_list(F.struct("country", "n")))
    path = new_path(spark, "countries")
    by_species = counts.groupBy("species").agg(inner.alias("m"))
    by_species.select(F.to_json(F.create_map("species", "m")).alias("value"), "species").repartition(
        "species").write.partitionBy("species").text(path)
    return readers.scan_country_json(spark, path + "/*")


@query("src07_scan_country_lists", COUNTRIES + "select species, string_agg(country, ',' order by country) countries from n group by 1")
def scan_country_lists(spark, d):
    counts = occurrences(spark, d).distinct()
    path = new_path(spark, "countries")
    by_species = counts.groupBy("species").agg(F.array_sort(F.collect_list("country")).alias("c"))
    by_species.select(F.to_json(F.create_map("species", "c")).alias("value"), "species").repartition(
        "species").write.partitionBy("species").text(path)
    listed = readers.scan_country_json(spark, path + "/*", "lists")
    return listed.withColumn("countries", F.array_join(F.array_sort("countries"), ","))


@query("src09_scan_class_index", "select (row_number() over (order by s_suppkey) - 1)::int class_idx, s_suppkey species_id from supplier")
def scan_class_index(spark, d):
    path = new_path(spark, "classes")
    ordered = v.table(spark, d, "supplier").orderBy("s_suppkey").select(F.col("s_suppkey").cast("string"))
    ordered.coalesce(1).write.text(path)
    return readers.scan_class_index(spark, path)


@query("src10_scan_id_list", """select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 40)""")
def scan_id_list(spark, d):
    path = new_path(spark, "ids")
    v.table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").cast("string")).write.text(path)
    ids = readers.scan_id_list(spark, path, "l_partkey")
    return shaping.filter_isin(v.table(spark, d, "lineitem"), "l_partkey", ids).select("l_orderkey", "l_linenumber")


def round_trip(write):
    def run(spark, d):
        path = new_path(spark, "out")
        write(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), path)
        return spark.read.parquet(path)

    return run


LINES = "select l_orderkey, l_linenumber, l_suppkey, l_quantity from lineitem"
query("snk01_write_parquet", LINES)(round_trip(lambda df, p: writers.write_parquet(df, p, 4)))
query("snk02_write_parquet_by_key", LINES)(round_trip(lambda df, p: writers.write_parquet_by_key(df, p, 4, "l_suppkey")))
query("snk02_write_parquet_by_key_salted", LINES)(
    round_trip(lambda df, p: writers.write_parquet_by_key(df, p, 4, "l_suppkey", salts=3)))


def write_twice(df, path):
    writers.write_if_absent(df.sparkSession, lambda: df, path)
    writers.write_if_absent(df.sparkSession, lambda: df.where("false"), path)


query("snk04_write_if_absent", LINES)(round_trip(write_twice))


@query("snk03_write_pending_buckets", "select l_orderkey, l_linenumber, (l_suppkey % 4)::int sample_id from lineitem")
def write_pending_buckets(spark, d):
    """Half of the buckets, then the rest; the finished half is not made again."""
    path = new_path(spark, "buckets")
    line = v.table(spark, d, "lineitem").withColumn("sample_id", (F.col("l_suppkey") % 4).cast("int"))

    def make(rows):
        return rows.select("l_orderkey", "l_linenumber", "sample_id")

    writers.write_pending_buckets(line, "sample_id", 2, make, path)
    writers.write_pending_buckets(line, "sample_id", 4, make, path)
    return spark.read.parquet(path)


@query("snk06_write_table_csv", "select l_suppkey, count(*) n from lineitem group by 1")
def write_table_csv(spark, d):
    path = new_path(spark, "table")
    writers.write_table_csv(v.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), path)
    return spark.read.schema("l_suppkey bigint, n bigint").csv(path, header=True)


@query("snk07_audit", """select count(*) "rows", 2 "columns", 'struct<image_name:string,species_id:int>' schema_text,
  count(*) = (select count(*) from lineitem) as_expected from lineitem""")
def audit(spark, d):
    return writers.audit(v.obs(spark, d).select("image_name", "species_id"), v.table(spark, d, "lineitem").count())
