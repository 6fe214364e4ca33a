"""Rank correlation and rank tests of a value against an ordered or unordered factor.

All of them need, for each distinct value, how many rows of each level lie below it. That is one call of
the ordering operator with one count per level; what follows are sums over distinct values, so no group
or pair of groups is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import safe_div
from ..functions.distributions import chi2_p, normal_p, student_p
from ..session import stored
from .ordering import value_positions


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def level_positions(
    df: DataFrame,
    value: str,
    level: str,
    levels: Sequence,
    by: Sequence[str] = (),
) -> DataFrame:
    """Distinct values with ``n0, n1, ...`` rows per level, the same below and in total."""
    known = stored(df.where(F.col(level).isin(list(levels)) & F.col(value).isNotNull()).select(*by, value, level))
    counts = {f"n{i}": F.count_if(F.col(level) == v) for i, v in enumerate(levels)}
    placed = value_positions(known, value, by, counts)
    k = range(len(levels))
    return placed.withColumns(
        {
            "n": _total([F.col(f"n{i}") for i in k]),
            "total": _total([F.col(f"total_n{i}") for i in k]),
            "rank": _total([F.col(f"below_n{i}") for i in k]) + (_total([F.col(f"n{i}") for i in k]) + 1) / 2,
        }
    )


def spearman(
    df: DataFrame,
    value: str,
    level: str,
    levels: Sequence,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rank correlation per group, null where either side is constant, and the mean value per level."""
    placed = level_positions(df, value, level, levels, by)
    k = range(len(levels))
    centre = (F.col("total") + 1) / 2
    dx = F.col("rank") - centre
    # Mid-rank of a level: rows of lower levels plus the middle of its own.
    dy = [
        _total([F.col(f"total_n{j}") for j in range(i)]) + (F.col(f"total_n{i}") + 1) / 2 - centre for i in k
    ]
    weighted = placed.select(
        *by,
        "n",
        (F.col("n") * dx * dx).alias("_xx"),
        (_total([F.col(f"n{i}") * dy[i] * dy[i] for i in k])).alias("_yy"),
        (_total([F.col(f"n{i}") * dy[i] for i in k]) * dx).alias("_xy"),
        *[F.col(f"n{i}") for i in k],
        *[(F.col(value) * F.col(f"n{i}")).alias(f"_s{i}") for i in k],
    )
    sums = weighted.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("_xx").alias("_xx"),
        F.sum("_yy").alias("_yy"),
        F.sum("_xy").alias("_xy"),
        *[F.try_divide(F.sum(f"_s{i}"), F.sum(f"n{i}").cast("double")).alias(f"mean_{v}") for i, v in enumerate(levels)],
    )
    rho = safe_div("_xy", F.sqrt("_xx") * F.sqrt("_yy"))
    # Not greatest/least alone: they skip nulls and would turn an undefined correlation into 1.
    bounded = F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))
    return sums.select(*by, "n", bounded.alias("rho"), *[f"mean_{v}" for v in levels])


def with_spearman_p(correlated: DataFrame) -> DataFrame:
    """Two-sided p-value by the t approximation; null below three rows or without a correlation."""
    rho, free = F.col("rho"), (F.col("n") - 2).cast("double")
    t = F.when(F.abs(rho) >= 1, F.lit(float("inf"))).otherwise(
        rho * F.sqrt(safe_div(free, 1 - rho * rho))
    )
    p = student_p(F.when(free > 0, t), free)
    return correlated.withColumn("p_value", p)


def association(
    df: DataFrame, value: str, grade: str, grades: Sequence, by: Sequence[str]
) -> DataFrame:
    """Rank correlation of a value with its grade per group, mean per grade and what it says.

    Grade means come from the ranked distinct values as well, so the input is read once.
    """
    correlated = with_spearman_p(spearman(df, value, grade, grades, by))
    return correlated.withColumns(
        {
            "relation": labels.relation("rho", "p_value"),
            "interpretation": labels.interpretation("rho", "p_value"),
        }
    )


def _tie(n: Column) -> Column:
    n = n.cast("double")
    return n * n * n - n


def _rank_sums(df: DataFrame, value: str, level: str, levels: Sequence) -> DataFrame:
    """One row: rows and rank sum of every level, all rows, tie term."""
    placed = level_positions(df, value, level, levels)
    k = range(len(levels))
    return placed.agg(
        *[F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in k],
        *[F.sum(F.col(f"n{i}") * F.col("rank")).alias(f"r{i}") for i in k],
        F.sum("n").cast("double").alias("n"),
        F.sum(_tie(F.col("n"))).alias("ties"),
    )


def kruskal(df: DataFrame, value: str, level: str, levels: Sequence) -> DataFrame:
    """Kruskal-Wallis statistic with tie correction; levels without rows do not count."""
    one = _rank_sums(df, value, level, levels)
    k = range(len(levels))
    n = F.col("n")
    squares = _total(
        [F.coalesce(safe_div(F.col(f"r{i}") * F.col(f"r{i}"), F.col(f"n{i}")), F.lit(0.0)) for i in k]
    )
    raw = safe_div(F.lit(12.0) * squares, n * (n + 1)) - 3 * (n + 1)
    filled = _total([F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in k])
    return (
        one.select(
            n.cast("bigint").alias("n"),
            safe_div(raw, 1 - safe_div("ties", _tie(n))).alias("h"),
            (filled - 1).alias("df"),
        )
        .withColumn("p_value", chi2_p(F.col("h"), F.col("df").cast("double")))
    )


def _pairs(one: DataFrame, levels: Sequence, fields) -> DataFrame:
    """One row per pair of levels out of a one-row table; ``fields(i, j)`` gives its columns."""
    rows = [
        F.struct(
            F.lit(levels[i]).alias("level_a"),
            F.lit(levels[j]).alias("level_b"),
            *[c.alias(name) for name, c in fields(i, j).items()],
        )
        for i, j in combinations(range(len(levels)), 2)
    ]
    return one.select(F.explode(F.array(*rows)).alias("_pair")).select("_pair.*")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", name: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p-values of a table of tests (one row per pair of levels)."""
    whole = W.partitionBy(F.lit(0))
    ascending = whole.orderBy(F.asc_nulls_last(p))
    m = F.count(p).over(whole)
    step = F.when(F.col(p).isNotNull(), F.col(p) * m / F.row_number().over(ascending))
    up = whole.orderBy(F.desc_nulls_first(p), F.desc("_step")).rowsBetween(W.unboundedPreceding, 0)
    return (
        tests.withColumn("_step", step)
        .withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_step").over(up))))
        .drop("_step")
    )


def dunn(df: DataFrame, value: str, level: str, levels: Sequence) -> DataFrame:
    """Dunn's comparison of mean ranks for every pair of levels, Benjamini-Hochberg adjusted."""
    one = _rank_sums(df, value, level, levels)
    n = F.col("n")

    def fields(i: int, j: int) -> dict[str, Column]:
        ni, nj = F.col(f"n{i}"), F.col(f"n{j}")
        variance = n * (n + 1) / 12 - safe_div("ties", 12 * (n - 1))
        scale = F.sqrt(variance * (safe_div(F.lit(1.0), ni) + safe_div(F.lit(1.0), nj)))
        return {"z": safe_div(safe_div(f"r{i}", ni) - safe_div(f"r{j}", nj), scale)}

    tested = _pairs(one, levels, fields).withColumn("p_value", normal_p(F.col("z")))
    return benjamini_hochberg(tested)


def wilcoxon(df: DataFrame, value: str, level: str, levels: Sequence) -> DataFrame:
    """Rank-sum statistic of every pair of levels with continuity- and tie-corrected normal p-value.

    W of (a, b) counts the rows of a above each row of b, ties by half, which the counts below give
    directly: the pair needs no ranking of its own.
    """
    placed = level_positions(df, value, level, levels)
    pairs = list(combinations(range(len(levels)), 2))
    k = range(len(levels))
    one = placed.agg(
        *[F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in k],
        *[
            F.sum(F.col(f"n{i}") * (F.col(f"below_n{j}") + F.col(f"n{j}") / 2)).alias(f"w{i}_{j}")
            for i, j in pairs
        ],
        *[F.sum(_tie(F.col(f"n{i}") + F.col(f"n{j}"))).alias(f"t{i}_{j}") for i, j in pairs],
    )

    def fields(i: int, j: int) -> dict[str, Column]:
        ni, nj, w = F.col(f"n{i}"), F.col(f"n{j}"), F.col(f"w{i}_{j}")
        n = ni + nj
        variance = ni * nj / 12 * (n + 1 - safe_div(F.col(f"t{i}_{j}"), n * (n - 1)))
        shift = w - ni * nj / 2
        z = safe_div(shift - F.signum(shift) * 0.5, F.sqrt(variance))
        return {
            "n_a": ni.cast("bigint"),
            "n_b": nj.cast("bigint"),
            "w": F.when((ni > 0) & (nj > 0), w),
            "z": F.when((ni > 0) & (nj > 0), z),
        }

    return _pairs(one, levels, fields).withColumn("p_value", normal_p(F.col("z")))
