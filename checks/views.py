"""The survey-shaped views over the given tables, as DataFrames and as SQL for the comparison."""

from __future__ import annotations

import tempfile
from itertools import groupby
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import checks
import tileflow

# Tasks get the library's helpers with the job, also when the repository is not on their path.
cloudpickle.register_pickle_by_value(tileflow)
cloudpickle.register_pickle_by_value(checks)

H, W = 20, 24  # height and width of derived masks and images
EDGE = W * H
LIST_ROWS = 500_000  # predicted rows that one task makes into lists


def prepare(spark: SparkSession) -> None:
    """Give a local session a shared folder of its own when it names none; a cluster has to name one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tileflow-"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(*cols) -> F.Column:
    return F.concat(*[c.cast("string") for c in cols])


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled images with species, genus, family and measurements."""
    line = table(spark, d, "lineitem")
    taxa = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("int").alias("species_id"),
            F.col("s_name").alias("species"),
            F.col("n_name").alias("genus"),
            F.col("r_name").alias("family"),
        )
    )
    images = line.select(
        F.concat(text(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")), F.lit(".jpg")).alias("image_name"),
        F.col("l_suppkey").cast("int").alias("species_id"),
        F.col("l_returnflag").alias("organ"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("altitude"),
        F.col("l_tax").alias("latitude"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("longitude"),
    )
    return images.join(taxa, "species_id")


OBS = """obs as (
  select concat(l.l_orderkey, '-', l.l_linenumber, '.jpg') image_name, l.l_suppkey::int species_id, s.s_name species,
    n.n_name genus, r.r_name family, l.l_returnflag organ,
    case when l.l_linenumber % 4 <> 0 then l.l_quantity end altitude, l.l_tax latitude,
    case when l.l_linenumber % 3 <> 0 then l.l_discount end longitude
  from lineitem l join supplier s on s.s_suppkey = l.l_suppkey
  join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey)"""


def write_folders(spark: SparkSession, d: str, path: str) -> None:
    """A folder ``s_suppkey=...`` for every supplier with its name in a text file; the tasks write them themselves.

    Spark's own writer moves every folder from the driver, one after the other, when the job ends.
    """
    root = Path(path.removeprefix("file:"))

    def write(batches):
        rows = (r for pdf in batches for r in pdf.itertuples(index=False))
        done = 0
        for key, lines in groupby(rows, key=lambda r: r.s_suppkey):
            folder = root / f"s_suppkey={key}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "part-0.txt").write_text("".join(f"{'' if r.s_name is None else r.s_name}\n" for r in lines), "utf-8")
            done += 1
        yield pd.DataFrame({"folders": [done]})

    tasks = spark.sparkContext.defaultParallelism
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name").repartition(tasks, "s_suppkey")
    rows.sortWithinPartitions("s_suppkey").mapInPandas(write, "folders bigint").agg(F.sum("folders")).collect()


def plots(spark: SparkSession, d: str) -> DataFrame:
    """One dated plot name per order; a name may occur more than once."""
    o = table(spark, d, "orders")
    scheme = F.col("o_custkey") % 6
    prefix = (
        F.when(scheme == 0, "CBN-can-").when(scheme == 1, "GUARDEN-AMB-").when(scheme == 2, "LISAH-")
        .when(scheme == 3, "OPTMix-").when(scheme == 4, "RNNB-").otherwise("Misc-")
    )
    middle = F.when(scheme == 4, text(F.col("o_custkey") % 9, F.lit("-"))).otherwise("")
    day = F.lpad((F.col("o_orderkey") % 9000 + 100).cast("string"), 4, "0")
    name = F.concat(prefix, middle, (F.col("o_custkey") % 50).cast("string"), F.lit("-2023"), day)
    return o.select("o_orderkey", name.alias("quadrat_id"))


PLOT = """plot_name as (
  select o_orderkey, concat(case o_custkey % 6 when 0 then 'CBN-can-' when 1 then 'GUARDEN-AMB-' when 2 then 'LISAH-'
    when 3 then 'OPTMix-' when 4 then 'RNNB-' else 'Misc-' end,
    case when o_custkey % 6 = 4 then concat(o_custkey % 9, '-') else '' end,
    o_custkey % 50, '-2023', lpad((o_orderkey % 9000 + 100)::varchar, 4, '0')) quadrat_id
  from orders)"""


def pred_rows(spark: SparkSession, d: str) -> DataFrame:
    """Predicted species per plot, one row each, with flags for two predictors."""
    line = table(spark, d, "lineitem").join(plots(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select(
        "quadrat_id",
        F.col("l_suppkey").cast("bigint").alias("species_id"),
        F.col("l_orderkey").alias("visit"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") != "R").alias("in_a"),
        (F.col("l_discount") >= 0.03).alias("in_b"),
    )


PRED = PLOT + """, pred as (
  select p.quadrat_id, l.l_suppkey::bigint species_id, l.l_orderkey visit, l.l_linenumber pos, l.l_extendedprice score,
    l.l_returnflag <> 'R' in_a, l.l_discount >= 0.03 in_b
  from lineitem l join plot_name p on p.o_orderkey = l.l_orderkey)"""


def pred_lists(spark: SparkSession, d: str, flag: str | None = None) -> DataFrame:
    """One ordered label list per plot."""
    rows = pred_rows(spark, d)
    # by default Spark keeps the number of its shuffle partitions, and what a task holds grows with the table
    tasks = -(-table(spark, d, "lineitem").count() // LIST_ROWS)
    rows = (rows.where(flag) if flag else rows).repartition(max(tasks, spark.sparkContext.defaultParallelism), "quadrat_id")
    ordered = F.array_sort(F.collect_list(F.struct("visit", "pos", "species_id")))
    return rows.groupBy("quadrat_id").agg(
        F.transform(ordered, lambda e: e["species_id"]).alias("species_ids")
    )


def list_sql(name: str, flag: str = "true") -> str:
    return f"""{name} as (select quadrat_id, list(species_id order by visit, pos, species_id) species_ids
      from pred where {flag} group by quadrat_id)"""


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tile vectors; they serve as embeddings and as logits of 64 classes."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.concat(F.lit("img"), F.floor(F.col("vec_id") / 16).cast("string"), F.lit(".jpg")).alias("image_name"),
        (F.col("vec_id") % 16).cast("int").alias("tile"),
        "vec_id",
        F.col("label").alias("species_id"),
        "embedding",
    )


TILE = """tile_vec as (
  select concat('img', vec_id // 16, '.jpg') image_name, (vec_id % 16)::int tile, vec_id, label species_id, embedding
  from embeddings),
tile_num as (select vec_id, image_name, tile, species_id, generate_subscripts(embedding, 1) - 1 i,
  unnest(embedding)::double x from tile_vec)"""

PROB = TILE + """,
tile_exp as (select *, exp(x - max(x) over (partition by vec_id)) e from tile_num),
prob as (select vec_id, image_name, tile, species_id, i, e / sum(e) over (partition by vec_id) p from tile_exp)"""

UNIT = TILE + """,
unit as (select vec_id, image_name, tile, species_id, i, x / sqrt(sum(x * x) over (partition by vec_id)) u
  from tile_num)"""

KNN = UNIT + """,
pairs as (select q.vec_id query_id, n.vec_id nn_id, greatest(0, round(2 - 2 * sum(q.u * n.u), 12)) distance
  from unit q join unit n on q.i = n.i group by q.vec_id, n.vec_id),
knn as (select * from (select *, row_number() over (partition by query_id order by distance, nn_id) rank from pairs)
  where rank <= 10)"""


def masks_sql(name: str = "mask_px", shift: int = 0) -> str:
    """Pixels of one mask per supplier, by the same formula as ``mask_value``."""
    return f"""{name} as (select concat('m', s_suppkey) image_name, y, x,
      case when (y * 7 + x * 13 + s_suppkey * 5 + y * x + {shift} * 3) % 11 < 5 then 1 else 0 end v
      from supplier, range({H}) a(y), range({W}) b(x))"""


PIXELS = f"""px as (select concat('m', s_suppkey) image_name, y, x, c,
  (y * 7 + x * 13 + s_suppkey * 5 + y * x + c * 17) % 256 v
  from supplier, range({H}) a(y), range({W}) b(x), range(3) e(c))"""
