"""Filters on the panel and changes of shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import once, row_total, safe_div, sum_or_zero
from ..session import stored

PAIR = ("plot", "scenario", "species")
PLOT = ("plot", "scenario")


def restrict(
    panel: DataFrame,
    scenario: str | None = None,
    years: Sequence[int] | None = None,
    species: Sequence[str] | None = None,
    plots: Sequence | None = None,
) -> DataFrame:
    """Keep a scenario, dates, species and plots; all of it reaches the scan of a stored panel."""
    if scenario is not None:
        panel = panel.where(F.col("scenario") == scenario)
    for name, wanted in (("year", years), ("species", species), ("plot", plots)):
        if wanted is not None:
            panel = panel.where(F.col(name).isin(list(wanted)))
    return panel


def start_or_trailing(start: int, end: int, window: int) -> Column:
    """The start date or one of the ``window`` last dates up to ``end``."""
    year = F.col("year")
    return (year == start) | year.between(end - window + 1, end)


def at_dates(
    panel: DataFrame, dates: Mapping[str, int], keys: Sequence[str] = PAIR, missing: str = "null"
) -> DataFrame:
    """One row per key with one column per named date.

    A cell the panel does not hold stays null, or becomes zero with ``missing="zero"``, which is what a
    panel with explicit zeros gives without storing them. A key with two rows at one date is an error.
    One aggregate with explicit dates: a pivot would plan a second one.
    """
    at = {name: F.col("year") == date for name, date in dates.items()}
    picked = panel.where(F.col("year").isin(list(dates.values()))).groupBy(*keys).agg(
        *[F.max(F.when(cond, F.col("value"))).alias(name) for name, cond in at.items()],
        *[F.count_if(cond).alias(f"_{name}") for name, cond in at.items()],
    )
    values = {name: once(F.col(name), F.col(f"_{name}"), "duplicate cell in the panel") for name in at}
    if missing == "zero":
        values = {
            name: F.when(F.col(f"_{name}") == 0, F.lit(0.0)).otherwise(value) for name, value in values.items()
        }
    return picked.select(*keys, *[value.alias(name) for name, value in values.items()])


def two_dates(
    panel: DataFrame, start: int, end: int, keys: Sequence[str] = PAIR, missing: str = "null"
) -> DataFrame:
    """One row per key with the start value ``ini`` and the end value ``fin``; see ``at_dates``."""
    return at_dates(panel, {"ini": start, "fin": end}, keys, missing)


def drop_all_zero(panel: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Drop the rows of every key whose known values are all zero, and of keys without a known value."""
    zero = F.bool_and(F.col("value") == 0).over(W.partitionBy(*keys))
    return panel.withColumn("_zero", zero).where(~F.col("_zero")).drop("_zero")


def drop_absent(two_date: DataFrame, ini: str = "ini", fin: str = "fin") -> DataFrame:
    """Drop rows absent at both dates; an unknown value next to a zero cannot be judged and goes too."""
    return two_date.where(~((F.col(ini) == 0) & (F.col(fin) == 0)))


def _numbered_levels(panel: DataFrame, name: str, given: DataFrame | Sequence | None) -> DataFrame:
    """Distinct levels of a column with their places 0, 1, ... in level order, as a stored table."""
    if given is None:
        given = panel.select(name)
    elif not isinstance(given, DataFrame):
        given = panel.sparkSession.createDataFrame([(v,) for v in given], f"{name} {panel.schema[name].dataType.simpleString()}")
    levels = given.toDF(name).where(F.col(name).isNotNull()).distinct()
    return stored(levels.withColumn(f"_{name}", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(name)) - 1))


def densify(
    panel: DataFrame,
    species: DataFrame | Sequence[str] | None = None,
    years: DataFrame | Sequence[int] | None = None,
    keys: Sequence[str] = PLOT,
) -> DataFrame:
    """Panel with an explicit zero for every absent species and date of every plot.

    ``species`` and ``years`` list the cells that must be there, as a table of one column or a list; by default those of
    the panel. Cells outside the lists are kept, and a stored missing value stays missing.

    The levels are a table each, so the plan does not grow with them. A cell's place in the grid is a number; a window along
    the cells of a plot finds the gaps between one place and the next, and only the empty places in them are made. The
    panel is read once and placed by plot once. The output itself is plots x species x dates by definition.

    The number of partitions is fixed: sized by the rows that come in, as Spark would do by itself, a
    partition would be far too large once they have been multiplied.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = {"species": _numbered_levels(panel, "species", species), "year": _numbered_levels(panel, "year", years)}
    size = {name: table.agg(F.count("*")).scalar() for name, table in levels.items()}
    grid = size["species"] * size["year"]
    placed = panel.select(*keys, "species", "year", "value")
    for name, table in levels.items():
        placed = placed.join(table, name, "left")
    placed = placed.withColumn("_at", F.col("_species") * size["year"] + F.col("_year")).repartition(parts, keys[0])
    along = W.partitionBy(*keys).orderBy(F.asc_nulls_last("_at"), "species", "year")
    cell = F.struct("species", "year")
    placed = placed.withColumns(
        {
            "_first": F.row_number().over(along) == 1,
            "_next": F.lead("_at").over(along),
            "_again": F.lead(cell).over(along).eqNullSafe(cell),
        }
    )

    def between(low: Column, high: Column) -> Column:  # places low .. high - 1
        return F.when(low < high, F.sequence(low, high - 1))

    none = F.array().cast("array<bigint>")
    ahead = F.when(F.col("_first"), between(F.lit(0).cast("bigint"), F.coalesce("_at", grid)))
    behind = between(F.col("_at") + 1, F.coalesce("_next", grid))
    gaps = F.concat(*[F.coalesce(g.cast("array<bigint>"), none) for g in (ahead, behind)])
    checked = F.when(F.col("_again"), F.raise_error(F.lit("duplicate cell in the panel"))).otherwise(gaps)
    # The row itself stands first, without a place.
    every = placed.select(*keys, "species", "year", "value", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), checked)).alias("_gap"))
    named = {name: table.withColumnRenamed(name, f"_{name}_name") for name, table in levels.items()}
    row = every.withColumns({"_species": F.floor(F.col("_gap") / size["year"]).cast("int"), "_year": (F.col("_gap") % size["year"]).cast("int")})
    for name, table in named.items():
        row = row.join(table, f"_{name}", "left")
    empty = F.col("_gap").isNotNull()
    return row.select(
        *keys,
        *[F.when(empty, F.col(f"_{name}_name")).otherwise(F.col(name)).alias(name) for name in levels],
        F.when(empty, F.lit(0.0)).otherwise(F.col("value")).alias("value"),
    )


def shares(panel: DataFrame, by: Sequence[str] = (*PLOT, "year")) -> DataFrame:
    """Add the plot total of the date and each species' share of it; null where the total is zero.

    A window holds one plot at one date, at most one row per species.
    """
    total = sum_or_zero("value", W.partitionBy(*by))
    return panel.withColumn("total", total).withColumn("share", safe_div("value", "total"))


def plot_totals(panel: DataFrame, by: Sequence[str] = (*PLOT, "year")) -> DataFrame:
    return panel.groupBy(*by).agg(sum_or_zero("value").alias("total"))


def to_wide(panel: DataFrame, species: Sequence[str], ids: Sequence[str] = (*PLOT, "year")) -> DataFrame:
    """One column per species. For a sink only: the operators of this library stay long."""
    cell = [F.count(F.lit(1)).alias("rows"), F.max("value").alias("value")]
    wide = panel.groupBy(*ids).pivot("species", list(species)).agg(*cell)
    return wide.select(
        *ids,
        *[
            once(F.col(f"`{s}_value`"), F.col(f"`{s}_rows`"), "duplicate cell in the panel").alias(s)
            for s in species
        ],
    )


def wide_total(wide: DataFrame, species: Sequence[str], name: str = "total") -> DataFrame:
    """Row total over the species columns, missing cells skipped."""
    return wide.withColumn(name, row_total([F.col(f"`{s}`") for s in species]))


def to_long(wide: DataFrame, species: Sequence[str], ids: Sequence[str] = (*PLOT, "year")) -> DataFrame:
    """Species columns back to rows."""
    return wide.unpivot(list(ids), [F.col(f"`{s}`") for s in species], "species", "value")


def trailing_ratio(panel: DataFrame, value: str, lag: int, keys: Sequence[str] = PAIR) -> DataFrame:
    """Value of every date against the one exactly ``lag`` dates earlier, where both exist.

    The frame is a range of dates, not of rows, so missing dates do not shift the pairing, and the panel
    is read once where a self-join would read it twice.
    """
    earlier = W.partitionBy(*keys).orderBy("year").rangeBetween(-lag, -lag)
    paired = panel.select(
        *keys,
        "year",
        F.col(value).alias("now"),
        F.max(value).over(earlier).alias("before"),
        F.count("*").over(earlier).alias("_found"),
    )
    return paired.where(F.col("_found") > 0).drop("_found").withColumn("ratio", safe_div("now", "before"))


def stack(frames: dict[str, DataFrame], label: str = "model") -> DataFrame:
    """Put tables of the same columns under each other, labelled by where each came from."""
    stacked = None
    for name, frame in frames.items():
        part = frame.withColumn(label, F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked
