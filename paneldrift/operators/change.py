"""Change between two dates: indicators, smoothed indicators, change metrics and share ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import safe_div, sum_or_zero
from .reshape import PAIR, PLOT, at_dates, drop_absent, start_or_trailing, two_dates


def _growth(ini: Column, fin: Column) -> Column:
    return F.when(ini > 0, fin * 100 / ini - 100)


def with_indicators(
    two_date: DataFrame, by: Sequence[str] = PLOT, dominance: float = labels.DOMINANCE
) -> DataFrame:
    """Plot totals, growth, shift of share and stand type for rows that hold ``ini`` and ``fin``.

    Everything comes from one window per plot. Its rows are distinct species of the plot, so its size is
    bounded by the species list whatever the number of observations. Rows absent at both dates add
    nothing to totals or to the largest share, so they may go after the window.
    """
    w = W.partitionBy(*by)
    ini, fin = F.col("ini"), F.col("fin")
    measured = two_date.withColumns(
        {
            "evol": fin - ini,
            "total_ini": sum_or_zero("ini", w),
            "total_fin": sum_or_zero("fin", w),
            "_top": F.max("ini").over(w),
        }
    ).withColumns(
        {
            "growth_pct": _growth(ini, fin),
            "share_shift": safe_div(fin * 100, F.col("total_fin")) - safe_div(ini * 100, F.col("total_ini")),
            "max_share": safe_div("_top", "total_ini"),
        }
    )
    typed = measured.withColumn("stand_type", labels.stand_type("max_share", dominance)).drop("_top")
    return drop_absent(typed)


def indicators(
    panel: DataFrame,
    start: int,
    end: int,
    keys: Sequence[str] = PAIR,
    by: Sequence[str] = PLOT,
    missing: str = "null",
    dominance: float = labels.DOMINANCE,
) -> DataFrame:
    """Two-date indicators of every species of every plot."""
    return with_indicators(two_dates(panel, start, end, keys, missing), by, dominance)


def dominant_species(two_date: DataFrame, by: Sequence[str] = PLOT, dominance: float = labels.DOMINANCE) -> DataFrame:
    """Per plot the species with the largest start value, its share, and the stand type; of equal ones the first by name.

    Plots without any known start value have no dominant species. A plot has one row per species, so the aggregate's state
    is one row.
    """
    known = two_date.where(F.col("ini") > 0)
    found = known.groupBy(*by).agg(
        F.min(F.struct((-F.col("ini")).alias("_less"), "species")).alias("_first"), F.sum("ini").alias("_total")
    )
    found = found.select(*by, F.col("_first.species").alias("dominant"), (-F.col("_first._less")).alias("_top"), "_total")
    share = safe_div("_top", "_total")
    return found.select(*by, "dominant", share.alias("max_share"), labels.stand_type(share, dominance).alias("stand_type"))


def smoothed_dates(
    panel: DataFrame,
    start: int,
    end: int,
    window: int = 15,
    keys: Sequence[str] = PAIR,
    missing: str = "null",
) -> DataFrame:
    """Start value and mean of the trailing dates, for keys that have a start row.

    Several start rows of one key give several results. With ``missing="zero"`` the panel is read as if
    it held a zero wherever a cell is absent: keys without a start row then start at zero, and the mean
    runs over all ``window`` dates but those whose stored value is missing.

    Rows are added up per key and start value before they are brought together, so many equal cells
    cost no more than one.
    """
    year, value = F.col("year"), F.col("value")
    tail = year.between(end - window + 1, end)
    summed = (
        panel.where(start_or_trailing(start, end, window))
        .withColumns({"_start": year == start, "ini": F.when(year == start, value)})
        .groupBy(*keys, "_start", "ini")
        .agg(
            F.count("*").alias("_copies"),
            F.sum(F.when(tail, value)).alias("_sum"),
            F.count(F.when(tail, value)).alias("_n"),
            F.count_if(tail & value.isNull()).alias("_unknown"),
        )
    )
    w = W.partitionBy(*keys)
    if missing == "zero":
        mean = safe_div(F.coalesce(F.sum("_sum").over(w), F.lit(0.0)), F.lit(window) - F.sum("_unknown").over(w))
        starts = F.bool_or("_start").over(w)
        first = F.row_number().over(w.orderBy("_start"))
        filled = summed.withColumns({"fin": mean, "_has": starts, "_first": first})
        kept = filled.where(F.col("_start") | (~F.col("_has") & (F.col("_first") == 1)))
        kept = kept.withColumns(
            {
                "ini": F.when(F.col("_start"), F.col("ini")).otherwise(F.lit(0.0)),
                "_copies": F.when(F.col("_start"), F.col("_copies")).otherwise(F.lit(1)),
            }
        )
    else:
        mean = safe_div(F.sum("_sum").over(w), F.sum("_n").over(w))
        kept = summed.withColumn("fin", mean).where(F.col("_start"))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*keys, "ini", "fin")


def smoothed_indicators(
    panel: DataFrame,
    start: int,
    end: int,
    window: int = 15,
    keys: Sequence[str] = PAIR,
    by: Sequence[str] = PLOT,
    missing: str = "null",
    dominance: float = labels.DOMINANCE,
) -> DataFrame:
    """Indicators whose end value is the mean of the last ``window`` dates."""
    return with_indicators(smoothed_dates(panel, start, end, window, keys, missing), by, dominance)


def change_metrics(
    panel: DataFrame, start: int, end: int, keys: Sequence[str] = PAIR, by: Sequence[str] = PLOT
) -> DataFrame:
    """Loss, arrival or growth of every species that is present at one of the two dates.

    One aggregate per species and one window per plot give what two total tables joined back would.
    """
    year, value = F.col("year"), F.col("value")
    held = {"s": year == start, "e": year == end}
    pairs = (
        panel.where(year.isin(start, end))
        .groupBy(*keys)
        .agg(
            *[F.sum(F.when(cond, F.coalesce(value, F.lit(0.0)))).alias(f"_{n}") for n, cond in held.items()],
            F.bool_and(value == 0).alias("_zero"),
        )
        .where(~F.col("_zero"))
    )
    w = W.partitionBy(*by)
    s, e = F.col("start_value"), F.col("end_value")
    share_s, share_e = safe_div(s, F.col("total_start")) * 100, safe_div(e, F.col("total_end")) * 100
    loss = F.when(s > 0, (s - e) / s * 100)
    return (
        pairs.withColumns({"total_start": F.sum("_s").over(w), "total_end": F.sum("_e").over(w)})
        .withColumns({"start_value": F.coalesce("_s", F.lit(0.0)), "end_value": F.coalesce("_e", F.lit(0.0))})
        .withColumns(
            {
                "diff_abs": F.when(s > 0, e - s),
                "pct_loss": F.when(loss >= 0, loss),
                "pct_appear": F.when(s == 0, share_e),
            }
        )
        .withColumn(
            "pct_growth",
            F.when(F.col("pct_loss").isNull() & F.col("pct_appear").isNull(), share_e - share_s),
        )
        .drop("_s", "_e", "_zero")
    )


def with_classes(metrics: DataFrame, presence_above: float = 1.0, loss_threshold: float = 50.0) -> DataFrame:
    """Quarter classes of loss and arrival, presence at the end and how likely it is to last."""
    return metrics.withColumns(
        {
            "appear_class": labels.quartile_class("pct_appear"),
            "loss_class": labels.quartile_class("pct_loss"),
            "presence": labels.presence("end_value", presence_above),
        }
    ).withColumn(
        "likelihood",
        labels.presence_likelihood("presence", "pct_loss", "pct_appear", "pct_growth", loss_threshold),
    )


def share_change(
    panel: DataFrame,
    start: int,
    end: int,
    lag: int | None = None,
    keys: Sequence[str] = PAIR,
    by: Sequence[str] = PLOT,
) -> DataFrame:
    """Shares of the plot total at both dates, their ratio and difference, and the evolution they show.

    With ``lag`` also the ratio of the end share to the share ``lag`` dates before. The dates are picked
    first, so the window that adds up a plot sees one row per species.
    """
    dates = {"share_start": start, "share_end": end}
    if lag is not None:
        dates["share_before"] = end - lag
    w = W.partitionBy(*by)
    picked = at_dates(panel, dates, keys)
    composed = picked.withColumns({name: safe_div(name, sum_or_zero(name, w)) for name in dates})
    compared = composed.withColumns(
        {
            "share_ratio": safe_div("share_end", "share_start"),
            "share_diff": F.col("share_end") - F.col("share_start"),
            "evolution": labels.evolution_from_shares("share_start", "share_end"),
        }
    )
    if lag is not None:
        compared = compared.withColumn("trailing_ratio", safe_div("share_end", "share_before"))
    return compared


def with_growth_evolution(measured: DataFrame) -> DataFrame:
    return measured.withColumn(
        "evolution", labels.evolution_from_growth("growth_pct", "share_shift", "total_ini", "total_fin")
    )


def with_agreement(evolved: DataFrame, grade: str = "grade") -> DataFrame:
    """Whether the modelled evolution agrees with the external grade."""
    return evolved.withColumn("agreement", labels.agreement("evolution", grade))
