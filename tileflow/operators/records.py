"""Structured model responses: parsing, validation, filters and what still has to be asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.operators.numbering import dense_row_id
from tileflow.sources.tables import settle

# Fields of a species filter response (the answers may be null = not known).
FILTER_SCHEMA = (
    "species_id int, scientific_name string, filter_is_vascular boolean, filter_is_quadrat_relevant boolean, "
    "filter_is_in_europe boolean, filter_is_in_pyrenees_med boolean, justification string"
)

# Fields of a scene description, and the values two of them may take.
SCENE_SCHEMA = (
    "image_filename string, image_capture_date string, derived_season string, metadata_inferred_region string, "
    "metadata_inferred_ecoregion string, estimated_region_visual string, habitat_predicted_types array<string>, "
    "habitat_reasoning string, habitat_substrate_appearance array<string>, cover_veg_pct double, "
    "cover_ground_pct double, cover_rock_pct double, cover_litter_pct double, cover_reasoning string, "
    "non_plant_elements array<string>, veg_dominant_forms array<string>, veg_dominant_forms_reasoning string, "
    "veg_height_cm string, veg_height_reasoning string, veg_canopy_structure string, veg_canopy_reasoning string, "
    "veg_woodiness_observed boolean, visual_phenology_notes string, trait_leaf_types array<string>, "
    "trait_flower_colors array<string>, trait_flower_shapes array<string>, trait_other_features array<string>, "
    "diversity_estimated_richness double, diversity_richness_confidence string, diversity_richness_reasoning string, "
    "taxa_suggested_groups array<string>, taxa_groups_reasoning string, summary_overall string, "
    "transcription_changes string"
)
SCENE_ENUMS = {
    "derived_season": ("Spring", "Summer", "Autumn", "Winter"),
    "diversity_richness_confidence": ("Low", "Medium", "High"),
}


def parse_record_blocks(df: DataFrame, keep: Sequence[str], text: str, fields: Sequence[str]) -> DataFrame:
    """``key: value`` blocks between ``---`` lines -> one row per block with the wanted fields.

    A field that a block does not have is null.
    """
    blocks = F.filter(F.split(F.col(text), r"(?m)^---\s*$"), lambda b: F.length(F.trim(b, F.lit(" \n"))) > 0)
    rows = df.select(*keep, F.posexplode(blocks).alias("block", "_text"))
    values = [
        F.when(F.col("_text").rlike(rf"(?m)^\s*{name}:"),
               F.trim(F.regexp_extract("_text", rf"(?m)^\s*{name}:[ \t]*(.*)$", 1))).alias(name)
        for name in fields
    ]
    return rows.select(*keep, "block", *values)


def parse_structured(df: DataFrame, keep: Sequence[str], text: str, schema: str) -> DataFrame:
    """JSON array responses -> one row per element; a response that is no valid array gives one row with
    ``is_corrupt`` set and null fields."""
    parsed = F.from_json(F.col(text), f"array<struct<{_fields(schema)}>>", {"mode": "PERMISSIVE"})
    rows = df.select(*keep, parsed.alias("_parsed"), F.col(text).alias("_text"))
    corrupt = F.col("_parsed").isNull() & F.col("_text").isNotNull()
    return rows.select(*keep, corrupt.alias("is_corrupt"), F.explode_outer("_parsed").alias("_r")).select(
        *keep, "is_corrupt", "_r.*"
    )


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in schema.split(", ")))


def validate_batch(
    requests: DataFrame, responses: DataFrame, batch: str, key: str,
    enums: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] = (),
) -> DataFrame:
    """Per batch: requested keys without a response, responses nobody asked for, responses with a missing
    or unknown value, and ``status`` = ``ok`` or ``failed``."""
    bad = F.lit(False)
    for name in required:
        bad = bad | F.col(name).isNull()
    for name, values in (enums or {}).items():
        bad = bad | (F.col(name).isNotNull() & ~F.col(name).isin(list(values)))
    asked = requests.select(batch, key).distinct().withColumn("_asked", F.lit(True))
    given = responses.groupBy(batch, key).agg(F.max(bad).alias("_bad"))
    both = asked.join(given, [batch, key], "full_outer")
    report = both.groupBy(batch).agg(
        F.count_if(F.col("_bad").isNull()).alias("n_missing"),
        F.count_if(F.col("_asked").isNull()).alias("n_unexpected"),
        F.count_if("_bad").alias("n_bad"),
    )
    wrong = (F.col("n_missing") + F.col("n_unexpected") + F.col("n_bad")) > 0
    return report.withColumn("status", F.when(wrong, "failed").otherwise("ok"))


def write_validated(responses: DataFrame, report: DataFrame, batch: str, path: str, stamp: str) -> None:
    """Responses under ``status=ok/`` or ``status=failed/``; failures carry the time stamp of the attempt."""
    rows = responses.join(report.select(batch, "status"), batch).withColumn(
        "attempt", F.when(F.col("status") == "failed", F.lit(stamp))
    )
    rows.write.mode("append").partitionBy("status").parquet(path)


def three_valued_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``rejected`` = any of the answers is a plain no; null means not known and keeps the row."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.coalesce(F.col(c), F.lit(True))
    return df.withColumn("rejected", ~keep)


def habitat_sets(plots: DataFrame, plot: str, habitats: str) -> tuple[DataFrame, DataFrame]:
    """The distinct habitat sets, ``set_id, <habitats>`` (sorted), and the plots with theirs, ``<plot>, set_id``.

    Sets are numbered from 0 in their order; an empty set is one. Plots without habitats (null) have no ``set_id``.
    """
    rows = plots.select(plot, F.array_sort(F.array_distinct(habitats)).alias("_set"))
    distinct = rows.where("_set is not null").select("_set").distinct()
    sets = settle(dense_row_id(distinct, ["_set"], "set_id"), "sets")
    members = rows.join(sets, "_set", "left").select(plot, "set_id")
    return sets.select("set_id", F.col("_set").alias(habitats)), members


def candidates_by_set(sets: DataFrame, species: DataFrame, item: str, habitats: str) -> DataFrame:
    """Species that share at least one habitat with a set: ``set_id, <item>``, each once.

    With ``habitat_sets`` this is the whole answer in sets x species rows; plots join it by ``set_id``.
    """
    wanted = sets.select("set_id", F.explode(habitats).alias("_h"))
    offered = species.select(item, F.explode(habitats).alias("_h")).distinct()
    return wanted.join(offered, "_h").select("set_id", item).distinct()


def candidates_by_habitat(
    plots: DataFrame, species: DataFrame, plot: str, item: str, habitats: str, measures: Sequence[Column] = ()
) -> DataFrame:
    """Species that share at least one habitat with a plot: ``plot, item``.

    The pairs written out; ``habitat_sets`` and ``candidates_by_set`` hold the same in far fewer rows. A plot that is
    listed more than once has the habitats of all its rows. With ``measures`` (aggregates over the species of a plot)
    there is one row for each plot with candidates: plots of one set share their species, so these are aggregated once
    for each set, and the pairs of plots and species are not written out.
    """
    # one row and so one set for each plot: no pair comes twice, and the pairs need no shuffle
    whole = plots.groupBy(plot).agg(F.flatten(F.collect_list(habitats)).alias(habitats))
    sets, members = habitat_sets(whole, plot, habitats)
    found = candidates_by_set(sets, species, item, habitats)
    if measures:
        of_set = found.groupBy("set_id").agg(*measures)
        return members.join(of_set, "set_id").drop("set_id")
    return members.join(found, "set_id").select(plot, item)


def missing_batches(batches: DataFrame, outputs: DataFrame, on: str) -> DataFrame:
    """The work list: batches that have no output yet."""
    return batches.join(outputs.select(on).distinct(), on, "left_anti")


def attempt_summary(batches: DataFrame, attempts: DataFrame, on: str) -> DataFrame:
    """Batches per state: ``success``, ``failed`` (tried without success) or ``skipped`` (not tried)."""
    best = attempts.groupBy(on).agg(F.max((F.col("status") == "ok").cast("int")).alias("_ok"))
    state = F.when(F.col("_ok") == 1, "success").when(F.col("_ok") == 0, "failed").otherwise("skipped")
    joined = batches.select(on).distinct().join(best, on, "left")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
