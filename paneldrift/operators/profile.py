"""Profiles of a table: levels, frequencies, contingency, summaries and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_div
from ..session import stored
from .enrich import join_null_safe, join_weighted
from .ordering import quantiles_of, selected_positions, with_positions


def levels_of(df: DataFrame, name: str) -> list:
    """Sorted levels of a categorical column, for wide tables, whose columns they become."""
    return sorted(r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().collect())


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()


def level_codes(df: DataFrame, name: str) -> DataFrame:
    """Each level of a categorical column with its position in the level order."""
    kept = stored(df)
    levels = kept.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_copies"))
    numbered = with_positions(levels.withColumn("_one", F.lit(1).cast("bigint")), name, (), ["_one"])
    codes = stored(numbered.select(name, (F.col("below__one") + 1).cast("int").alias(f"{name}_code"), "_copies"))
    return join_weighted(kept, codes, (name,), "_copies").drop("_copies")


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any missing value."""
    return df.na.drop("any")


def frequency(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"))


def group_totals(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Total per category, unknown as soon as one value is unknown."""
    unknown = F.count("*") > F.count(value)
    return df.groupBy(by).agg(F.when(~unknown, F.sum(value)).alias("total"))


def contingency(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    """Counts of row level by column level, rows with a missing level left out, empty cells zero."""
    known = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return known.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(str(v)) for v in levels])


def contingency_shares(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Each cell of the contingency table as a share of its row."""
    cells = (
        df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
        .groupBy(rows, columns)
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(W.partitionBy(rows))
    return cells.withColumn("row_share", safe_div(F.col("n").cast("double"), total))


def grade_means(df: DataFrame, value: str, grade: str, grades: Sequence, by: Sequence[str]) -> DataFrame:
    """Mean of a value for each grade, and the row count, per group."""
    return df.groupBy(*by).agg(
        *[F.avg(F.when(F.col(grade) == g, F.col(value))).alias(f"mean_{g}") for g in grades],
        F.count("*").alias("n"),
    )


def numeric_profile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean, maximum, number of known and of missing values of each group.

    One pass counts and bounds the groups, and bounds them for the selection of the quartiles; see ``selected_positions``.
    """
    kept = stored(df.select(*by, value))
    groups = stored(
        kept.groupBy(*by).agg(
            F.count(value).alias("n"),
            F.count_if(F.col(value).isNull()).alias("n_missing"),
            F.min(value).alias("min"),
            F.avg(value).alias("mean"),
            F.max(value).alias("max"),
        )
    )
    known = kept.where(F.col(value).isNotNull())
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles_of(selected_positions(known, value, by, quartiles, groups), value, by, quartiles).drop("n")
    columns = [*by, "n", "n_missing", "min", "q1", "median", "mean", "q3", "max"]
    return join_null_safe(groups, found, by).select(*columns)


def table_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same of all numeric columns (or those named) at once, one row per column: rows are read as (column, value)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    named = list(columns or numeric)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in named]).unpivot([], named, "column", "value")
    return numeric_profile(long, "value", ("column",))


def box_stats(df: DataFrame, value: str, by: Sequence[str], limits: tuple[float, float] | None = None):
    """Box-plot statistics per category and the outlying values.

    Whiskers end at the most extreme value within 1.5 interquartile ranges of the box. ``limits``
    removes values outside a range before anything is computed. Returns (statistics, outliers).
    """
    if limits is not None:
        df = df.where(F.col(value).between(*limits))
    kept = stored(df.where(F.col(value).isNotNull()).select(*by, value))
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    # One row per category. Stored, its size is known when the join is planned: Spark sends it to the
    # values if it is small, instead of first shuffling the values by a few large categories.
    box = stored(
        quantiles_of(selected_positions(kept, value, by, quartiles), value, by, quartiles).withColumns(
            {
                "_low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                "_high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
            }
        )
    )
    by = list(by)
    placed = join_null_safe(kept, box, by, "inner")
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    stats = placed.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    outliers = placed.where(~inside).groupBy(*by, value).agg(F.count("*").alias("n"))
    return stats, outliers
