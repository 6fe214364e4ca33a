"""Points in a box and in a country outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

# --- Fixed values: crop of the country outline, and the map view (west, east, south, north) ---

CROP = (-5.5, 9.8, 41.0, 51.5)
VIEW = (-5.5, 10.0, 41.0, 52.0)

# --- End of fixed values ---


def located(df: DataFrame, lon: str = "lon", lat: str = "lat", seen: Observation | None = None) -> DataFrame:
    """Rows with both coordinates. ``seen`` counts the others, ``n_unlocated``, in the pass that uses the rows."""
    if seen is not None:
        df = df.observe(seen, F.count_if(F.col(lon).isNull() | F.col(lat).isNull()).alias("n_unlocated"))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def unlocated_count(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """How many rows lack a coordinate."""
    return df.agg(F.count_if(F.col(lon).isNull() | F.col(lat).isNull()).alias("n_unlocated"))


def in_box(df: DataFrame, box: tuple[float, float, float, float] = CROP) -> DataFrame:
    west, east, south, north = box
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


# Grid lines through the centres of cells are kept off round coordinates.
ORIGIN = (0.0123456789, 0.0098765432)


def _edges(rings: DataFrame) -> DataFrame:
    """Edges of all rings, each ring closed."""
    ring = W.partitionBy("region", "ring_id").orderBy("seq")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rings.select(
        "region",
        F.col("lon").alias("x1"),
        F.col("lat").alias("y1"),
        F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole)).alias("x2"),
        F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole)).alias("y2"),
    ).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _cell(c, axis: int, size: float):
    return F.floor((c - F.lit(ORIGIN[axis])) / F.lit(size)).cast("int")


def _at(e, c, along: str, across: str):
    """Where an edge has the coordinate c along one axis, on the other; and whether it passes c at all."""
    a1, a2, b1, b2 = e[f"{along}1"], e[f"{along}2"], e[f"{across}1"], e[f"{across}2"]
    return b1 + (c - a1) * F.try_divide(b2 - b1, a2 - a1), (a1 > c) != (a2 > c)


def region_cells(rings: DataFrame, size: float) -> DataFrame:
    """Cells of a grid that regions reach, with their regions: ``_row``, ``_col`` and ``_in``.

    A cell lies inside a region, without more, or has the edges of the region that pass it and tells whether its centre lies
    inside. Each region has its own even-odd count, so regions may overlap and have holes and islands. A region has as many
    rows as cells of its area; a list holds the edges of one cell.
    """
    e = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    slack = size * 1e-9  # an edge on the border of two cells belongs to both
    edges = _edges(rings)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("_row", F.explode(F.sequence(_cell(low - slack, 1, size), _cell(high + slack, 1, size))))
    base = F.lit(ORIGIN[1]) + F.col("_row") * F.lit(size)
    ends = [_at(e, F.greatest(low, F.least(high, y)), "y", "x")[0] for y in (base, base + size)]
    xs = [F.coalesce(x, F.col(c)) for x, c in zip(ends, ("x1", "x2"))]  # a level edge passes all its cells
    left, right = F.least(*xs) - slack, F.greatest(*xs) + slack
    centre, passes = _at(e, base + size / 2, "y", "x")
    middle = F.lit(ORIGIN[0]) + (F.col("_col") + 0.5) * F.lit(size)
    here = passes & (_cell(centre, 0, size) == F.col("_col"))
    cells = (
        rows.withColumn("_col", F.explode(F.sequence(_cell(left, 0, size), _cell(right, 0, size))))
        .groupBy("region", "_row", "_col")
        .agg(
            F.collect_list(F.struct(*e)).alias("_edges"),
            F.count_if(here).alias("_n"),
            F.count_if(here & (centre > middle)).alias("_east"),
        )
    )
    along = W.partitionBy("region", "_row").orderBy("_col")
    beyond = F.coalesce(F.sum("_n").over(along.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    cells = cells.withColumns({"_beyond": beyond, "_before": F.lag("_col").over(along)})
    passed = cells.select("region", "_row", "_col", ((F.col("_beyond") + F.col("_east")) % 2 == 1).alias("inside"), "_edges")
    # Between two cells that edges pass, all cells are inside or none is.
    gap = ((F.col("_beyond") + F.col("_n")) % 2 == 1) & (F.col("_col") - F.col("_before") > 1)
    filled = cells.where(gap).select(
        "region", "_row", F.explode(F.sequence(F.col("_before") + 1, F.col("_col") - 1)).alias("_col"), F.lit(True).alias("inside")
    )
    every = passed.unionByName(filled, allowMissingColumns=True)
    return every.groupBy("_row", "_col").agg(F.collect_list(F.struct("region", "inside", "_edges")).alias("_in"))


def _placed(points: DataFrame, rings: DataFrame, size: float):
    """Points with the regions of their cell, and the test of one of these."""
    keyed = located(points).withColumns({"_row": _cell(F.col("lat"), 1, size), "_col": _cell(F.col("lon"), 0, size)})
    x, y = (F.lit(ORIGIN[i]) + (F.col(c) + 0.5) * F.lit(size) for i, c in ((0, "_col"), (1, "_row")))

    def turns(e):
        """Whether an edge lies between the cell's centre and the point, on the way north or south or on that east or west."""
        up, passes_up = _at(e, x, "x", "y")
        side, passes_side = _at(e, F.col("lat"), "y", "x")
        one = F.coalesce(passes_up & ((y < up) != (F.col("lat") < up)), F.lit(False))
        return one != F.coalesce(passes_side & ((x < side) != (F.col("lon") < side)), F.lit(False))

    def holds(region):
        odd = F.size(F.filter(F.coalesce(region["_edges"], F.array()), turns)) % 2 == 1
        return region["inside"] != odd

    # Stored, so that its size is known: Spark sends it to the points if it is small.
    return keyed.join(stored(region_cells(rings, size)), ["_row", "_col"]), holds


def within_rings(points: DataFrame, rings: DataFrame, size: float = 0.25) -> DataFrame:
    """Points inside any of the regions, by the even-odd rule within each, so holes and islands are right as well.

    The join is an equi-join on the grid cell with at most one match per point; only points in a cell that an edge passes
    are compared with edges, those of their cell.
    """
    placed, holds = _placed(points, rings, size)
    return placed.where(F.exists("_in", holds)).drop("_row", "_col", "_in")


def regions_of(points: DataFrame, rings: DataFrame, size: float = 0.25) -> DataFrame:
    """Points with ``region``, once for each region that they lie in."""
    placed, holds = _placed(points, rings, size)
    return placed.withColumn("region", F.explode(F.transform(F.filter("_in", holds), lambda r: r["region"]))).drop("_row", "_col", "_in")
