"""The three analyses end to end, as compositions of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import bootstrap, change, charts, enrich, rank_tests
from ..operators.reshape import PAIR, PLOT, restrict


def analysis_table(
    panel: DataFrame,
    start: int,
    end: int,
    scenario: str | None = None,
    site: DataFrame | None = None,
    graded: DataFrame | None = None,
    smooth: int | None = None,
    attributes: Sequence[str] = ("grade",),
    keys: Sequence[str] = PAIR,
    by: Sequence[str] = PLOT,
    missing: str = "null",
    dominance: float = labels.DOMINANCE,
) -> DataFrame:
    """Indicators, stand type, plot attributes and grade of every species of every plot.

    ``smooth`` is the number of trailing dates averaged for the end value (15 in the published
    analyses), None for the end date alone.
    """
    chosen = restrict(panel, scenario)
    if smooth is None:
        table = change.indicators(chosen, start, end, keys, by, missing, dominance)
    else:
        table = change.smoothed_indicators(chosen, start, end, smooth, keys, by, missing, dominance)
    if site is not None:
        table = enrich.attach_site(table, site)
    if graded is not None:
        lookup = enrich.grade_lookup(graded, start, end, scenario, attributes, missing)
        table = enrich.attach_grade(table, lookup)
    return table


def change_map(
    panel: DataFrame,
    site: DataFrame,
    start: int,
    end: int,
    scenario: str | None = None,
    presence_above: float = 1.0,
    loss_threshold: float = 50.0,
) -> DataFrame:
    """Change metrics, classes and coordinates, ready for ``charts.map_layer``."""
    metrics = change.change_metrics(restrict(panel, scenario), start, end)
    classed = change.with_classes(metrics, presence_above, loss_threshold)
    return enrich.attach_site(classed, site, ["lon", "lat"])


def grade_association(
    analysed: DataFrame,
    belts: DataFrame | None,
    by: Sequence[str],
    grades: Sequence = (1, 2, 3),
    belt_on: str = "species",
) -> DataFrame:
    """Rank correlation of growth with grade per group, most significant first."""
    rows = analysed if belts is None else enrich.attach_belt(analysed, belts, belt_on)
    found = rank_tests.association(rows, "growth_pct", "grade", grades, by)
    return found.orderBy(F.asc_nulls_last("p_value"))


def mixture_effect(
    analysed: DataFrame,
    group: str = "species",
    grades: Sequence = (1, 2, 3),
    n_iter: int = 5000,
    seed: int = 0,
) -> DataFrame:
    """Interval of the difference of correlation between single-species and mixed plots, per species."""
    replicates = bootstrap.bootstrap_diff(
        analysed, group, "stand_type", "growth_pct", "grade", grades, n_iter=n_iter, seed=seed
    )
    return bootstrap.bootstrap_summary(replicates, group)


def agreement_layer(analysed: DataFrame) -> DataFrame:
    """Map of where modelled evolution and grade agree, for grades other than the best."""
    judged = change.with_agreement(change.with_growth_evolution(analysed))
    return charts.map_layer(judged.where(F.col("grade") != 1), "agreement")
