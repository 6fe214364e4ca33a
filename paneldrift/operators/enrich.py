"""Joins: site attributes, grades, belts, totals, the two models side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import once
from .reshape import PLOT, restrict


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a missing key matches a missing key. Without keys, ``right`` is one row for all."""
    if not keys:
        row = right.select(F.struct("*")).scalar()
        return left.withColumns({c: row[c] for c in right.columns})
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    tests = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, reduce(lambda a, b: a & b, tests), how).drop(*[f"_right_{k}" for k in keys])


# Rows of one key that a task takes, and keys at most that are spread. The list of these goes to all tasks.
BLOCK, HEAVY = 1 << 17, 1000


def join_weighted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, place: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """Left null-safe join with a table of one row per key that counts the rows of ``left`` with the key in ``n``.

    A key with more rows than a block is spread over as many parts as it has blocks, and its row of ``right`` is repeated
    for each; all other rows stay single. A block is ``block`` rows, or more where that would make over HEAVY heavy keys.
    ``place`` spreads the rows of a key; by default their position does, and ``left`` must be a stored table then.
    ``right`` should be stored too: it is read three times.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint")).scalar()
    size = F.greatest(F.lit(block), F.ceil(total / F.lit(HEAVY)))
    heavy = right.where(F.col(n) > size).select(*keys, F.ceil(F.col(n) / size).cast("int").alias("_parts"))
    parts = join_null_safe(left, F.broadcast(heavy), keys).withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    where = F.monotonically_increasing_id() if place is None else place
    dealt = parts.withColumn("_spread", F.pmod(where, F.col("_parts")).cast("int")).drop("_parts")
    last = F.when(F.col(n) > size, F.ceil(F.col(n) / size)).otherwise(1).cast("int") - 1
    every = right.withColumn("_spread", F.explode(F.sequence(F.lit(0), last)))
    return join_null_safe(dealt, every, (*keys, "_spread")).drop("_spread")


def attach_site(df: DataFrame, site: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Left join of plot attributes. The site table grows with the plots, so Spark picks the strategy."""
    wanted = site if columns is None else site.select("plot", *columns)
    return df.join(wanted, "plot", "left")


def grade_lookup(
    graded: DataFrame,
    start: int,
    end: int,
    scenario: str | None = None,
    attributes: Sequence[str] = ("grade",),
    missing: str = "null",
) -> DataFrame:
    """Grade (and other attributes) of every species of every plot present at one of the two dates.

    An attribute that differs between rows of one plot and species is an error: joined as it stands it
    would repeat the rows it is attached to.
    """
    at = {"ini": F.col("year") == start, "fin": F.col("year") == end}
    # With one scenario chosen it is constant; naming it lets Spark share the panel's own shuffle.
    pair = ["plot", "species"] if scenario is None else ["plot", "scenario", "species"]
    found = (
        restrict(graded, scenario, (start, end))
        .groupBy(*pair, *attributes)
        .agg(
            *[F.max(F.when(cond, F.col("value"))).alias(n) for n, cond in at.items()],
            *[F.count_if(cond).alias(f"_{n}") for n, cond in at.items()],
        )
        .withColumn("_variants", F.count("*").over(W.partitionBy(*pair)))
    )
    values = {n: once(F.col(n), F.col(f"_{n}"), "duplicate cell in the panel") for n in at}
    if missing == "zero":
        values = {n: F.when(F.col(f"_{n}") == 0, 0.0).otherwise(v) for n, v in values.items()}
    found = found.withColumns(values)
    unique = [
        once(F.col(a), F.col("_variants"), f"more than one {a} for a plot and species").alias(a) for a in attributes
    ]
    return found.where(~((F.col("ini") == 0) & (F.col("fin") == 0)) | (F.col("_variants") > 1)).select(
        "plot", "species", *unique
    )


def grade_at(graded: DataFrame, date: int, key: str = "plot", species: str = "species") -> DataFrame:
    """Grades of one date only, under the panel's key names."""
    rows = graded.where(F.col("year") == date).groupBy(F.col(key).alias("plot"), F.col(species).alias("species"))
    return rows.agg(once(F.max("grade"), F.count("*"), "more than one grade row for a plot and species").alias("grade"))


def attach_grade(df: DataFrame, lookup: DataFrame) -> DataFrame:
    return df.join(lookup, ["plot", "species"], "left")


def attach_belt(df: DataFrame, belts: DataFrame, on: str = "species") -> DataFrame:
    """Inner join with the belt of each species: species without a belt go."""
    return df.join(belts.withColumnRenamed("species", on), on)


def belt_table(spark: SparkSession) -> DataFrame:
    """The eleven species with a known belt; a fixed table, hence safe to broadcast."""
    return F.broadcast(spark.createDataFrame(list(labels.BELTS.items()), "species string, belt string"))


def attach_totals(panel: DataFrame, start: int, end: int, keys: Sequence[str] = (*PLOT, "lon", "lat")) -> DataFrame:
    """Values of each species at both dates with the plot totals of those dates.

    The keys may be missing (a plot without coordinates): window partitions, like a null-safe join, put
    missing keys together, and need no second pass and no join.
    """
    held = {"start": F.col("year") == start, "end": F.col("year") == end}
    pairs = panel.where(F.col("year").isin(start, end)).groupBy(*keys, "species").agg(
        *[F.sum(F.when(cond, F.coalesce("value", F.lit(0.0)))).alias(f"_{n}") for n, cond in held.items()]
    )
    w = W.partitionBy(*keys)
    totals = pairs.withColumns({f"total_{n}": F.sum(f"_{n}").over(w) for n in held})
    return totals.withColumns({f"{n}_value": F.coalesce(f"_{n}", F.lit(0.0)) for n in held}).drop("_start", "_end")


def pair_models(
    m: DataFrame, p: DataFrame, value: str = "growth_pct", on: Sequence[str] = ("plot", "species_latin")
) -> DataFrame:
    """The same plot and species in both models, matched by key through the Latin name."""
    left = m.select(*on, F.col(value).alias("value_m"))
    right = p.select(*on, F.col(value).alias("value_p"))
    return left.join(right, list(on))


def pair_model_means(
    m: DataFrame, p: DataFrame, value: str = "growth_pct", on: Sequence[str] = ("species_latin",)
) -> DataFrame:
    """Mean per species in both models, for models whose plots do not correspond."""
    left = m.groupBy(*on).agg(F.avg(value).alias("value_m"))
    right = p.groupBy(*on).agg(F.avg(value).alias("value_p"))
    return left.join(right, list(on))
