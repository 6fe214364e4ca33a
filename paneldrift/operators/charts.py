"""Tables that a chart or map can be drawn from as they stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import short_number
from .profile import box_stats
from .reshape import restrict
from .spatial import located

# Layer: mapped column, class column, colours, column that must be known.
LAYERS = {
    "change": ("diff_abs", None, None, "diff_abs"),
    "loss": ("pct_loss", "loss_class", labels.LOSS_COLOURS, "pct_loss"),
    "appearance": ("pct_appear", "appear_class", labels.APPEAR_COLOURS, "pct_appear"),
    "presence": ("end_value", "presence", labels.PRESENCE_COLOURS, "presence"),
    "likelihood": ("end_value", "likelihood", labels.LIKELIHOOD_COLOURS, "likelihood"),
    "agreement": ("growth_pct", "agreement", labels.AGREEMENT_COLOURS, "agreement"),
}


def series(panel: DataFrame, scenario: str, plots: Sequence, species: Sequence[str] | None = None) -> DataFrame:
    """Value over time for some plots and species, in drawing order."""
    wanted = restrict(panel, scenario, species=species, plots=plots)
    return wanted.select("plot", "species", "year", "value").orderBy("plot", "species", "year")


def distribution_by_year(panel: DataFrame, species: str):
    """Box-plot statistics of one species for every date. Returns (statistics, outliers)."""
    return box_stats(restrict(panel, species=[species]), "value", ("year",))


def value_layer(
    panel: DataFrame, site: DataFrame, scenario: str, year: int, species: str | None = None
) -> DataFrame:
    """Map of the value of one species (or of each) at one date."""
    rows = restrict(panel, scenario, [year], species and [species])
    placed = rows.join(site.select("plot", "lon", "lat"), "plot", "left")
    return located(placed).select("plot", "species", "lon", "lat", F.col("value").alias("measure"))


def map_layer(df: DataFrame, layer: str, species: str | None = None) -> DataFrame:
    """Points of one map: measure, class and colour; rows without the mapped value are left out."""
    measure, label, colours, needed = LAYERS[layer]
    rows = df if species is None else df.where(F.col("species") == species)
    empty = F.lit(None).cast("string")
    return located(rows).where(F.col(needed).isNotNull()).select(
        "plot",
        "species",
        "lon",
        "lat",
        F.col(measure).alias("measure"),
        (F.col(label) if label else empty).alias("class"),
        (labels.colour(label, colours) if colours else empty).alias("colour"),
    )


def ordered_bars(totals: DataFrame, category: str, measure: str, facet: Sequence[str] = ()) -> DataFrame:
    """Bar table with the position of each bar, smallest first, within its facet.

    Rows are finished bars, one per category: the window sees a category list, not the data.
    """
    w = W.partitionBy(*(facet or [F.lit(0)])).orderBy(F.asc_nulls_last(measure), category)
    return totals.withColumn("sort_key", F.row_number().over(w))


def pick_bars(bars: DataFrame, order: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Bars at given positions of a stated order."""
    w = W.partitionBy(F.lit(0)).orderBy(*order)
    return bars.withColumn("_at", F.row_number().over(w)).where(F.col("_at").isin(list(positions))).drop("_at")


def correlation_bars(associations: DataFrame, category: str, facet: Sequence[str]) -> DataFrame:
    """Bars of rank correlations, labelled where significant."""
    text = F.when(F.col("p_value") < 0.05, F.concat(F.lit("ρ="), short_number("rho", 2))).otherwise("")
    coloured = associations.withColumns(
        {"label": text, "colour": labels.colour("relation", labels.RELATION_COLOURS)}
    )
    return ordered_bars(coloured, category, "rho", facet)
