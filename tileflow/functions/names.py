"""Column expressions over file names, plot names and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plot-name prefixes that identify a survey region, in matching order.
REGIONS = (
    "2024-CEV3",
    "CBN-can",
    "CBN-PdlC",
    "CBN-Pla",
    "CBN-Pyr",
    "GUARDEN-AMB",
    "GUARDEN-CBNMed",
    "LISAH-BOU",
    "LISAH-BVD",
    "LISAH-JAS",
    "LISAH-PEC",
    "OPTMix",
    "RNNB",
)

# The naming schemes of a repeatedly visited plot; group 1 is the plot.
PLOT_PATTERNS = (
    r"^(CBN-.*?-.*?)-\d{8}$",
    r"^(GUARDEN-.*?-.*?)-.*$",
    r"^(LISAH-.*?)-\d{8}$",
    r"^(OPTMix-\d+)-.*$",
    r"^(RNNB-\d+-\d+)-\d{8}$",
)


def relative_path(path: Column, base: str) -> Column:
    """Drop the literal prefix ``file:<base>`` wherever it occurs."""
    return F.replace(path, F.lit(f"file:{base}"), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_ext_last(name: Column) -> Column:
    """``a.b.jpg`` -> ``a.b``; a name without a dot stays as it is."""
    return F.regexp_replace(name, r"[.][^.]*$", "")


def strip_ext_first(name: Column) -> Column:
    """``a.b.jpg`` -> ``a``."""
    return F.substring_index(name, ".", 1)


def strip_jpg_all(name: Column) -> Column:
    """Remove every literal ``.jpg``."""
    return F.replace(name, F.lit(".jpg"), F.lit(""))


def region_of(name: Column, regions: Sequence[str] = REGIONS) -> Column:
    """First region that prefixes the name, or an empty string."""
    hit = F.when(F.lit(False), F.lit(""))
    for region in regions:
        hit = hit.when(name.startswith(region), F.lit(region))
    return hit.otherwise(F.lit(""))


def base_plot_id(plot: Column, patterns: Sequence[str] = PLOT_PATTERNS) -> Column:
    """Plot without visit date: group 1 of the first pattern that matches, else the input."""
    matches = [F.nullif(F.regexp_extract(plot, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*matches, plot)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "_")


def label_text(name: Column) -> Column:
    """``leaf_mask`` -> ``Leaf Mask``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def unit_number(text: Column) -> Column:
    """Leading whole number of ``37 %`` or ``512 MiB``; null when there is none."""
    return F.split(text, " ")[0].try_cast("int")


def log_time(text: Column) -> Column:
    """Epoch seconds of ``Wed Feb 05 10:11:12 2025`` (the weekday is not needed)."""
    day = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]+\s+", ""), r"\s+", " ")
    return F.unix_timestamp(F.try_to_timestamp(day, F.lit("MMM d HH:mm:ss yyyy")))


def capture_date(name: Column) -> Column:
    """Date in a name such as ``plot-20230705.jpg``; null when absent or impossible."""
    digits = F.regexp_extract(name, r"-([0-9]{8})", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")))


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .when(month.isin(9, 10, 11), "Autumn")
        .when(month.isNotNull(), "Winter")
    )


def grid_to_n(grid: Column) -> Column:
    """``4x4`` -> 4."""
    return F.split(grid, "x")[0].try_cast("int")


def n_to_grid(n: Column) -> Column:
    """4 -> ``4x4``."""
    side = n.cast("string")
    return F.concat(side, F.lit("x"), side)
