"""Linear models on a factor or on one regressor, analysis of variance, Tukey pairs, normality.

Every model needs only mergeable moments per level (count, mean, squared deviation), so the scan is a
partial aggregate and a level holding most rows costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.distributions import (
    chi2_p,
    fisher_p,
    normal_quantile,
    normal_upper,
    range_p,
    range_quantile,
    student_p,
)
from ..session import stored
from .enrich import join_weighted
from .ordering import mid_rank, value_positions
from .rank_tests import _pairs


def level_moments(df: DataFrame, y: str, level: str) -> DataFrame:
    """Rows, mean and squared deviations of each known level."""
    known = df.where(F.col(y).isNotNull() & F.col(level).isNotNull())
    return known.groupBy(level).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count("*")).alias("ss")
    )


def _fit(moments: DataFrame, level: str) -> DataFrame:
    """Model-wide numbers beside each level: a window over one row per level."""
    whole = W.partitionBy(F.lit(0))
    n, k = F.sum("n").over(whole), F.count("*").over(whole)
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / n
    first = F.min(F.struct(level, "n", "mean")).over(whole)
    fitted = moments.withColumns(
        {"n_all": n, "k": k, "_grand": grand, "ss_within": F.sum("ss").over(whole), "_first": first}
    )
    gap = F.col("mean") - F.col("_grand")
    return fitted.withColumns(
        {"ss_between": F.sum(F.col("n") * gap * gap).over(whole), "df_resid": F.col("n_all") - F.col("k")}
    ).withColumn("ms_within", safe_div("ss_within", F.col("df_resid").cast("double")))


def ols_factor(df: DataFrame, y: str, level: str) -> DataFrame:
    """Least squares on a factor, the first level as baseline: one row per coefficient."""
    return _coefficients(level_moments(df, y, level), level)


def _coefficients(moments: DataFrame, level: str, *more: str) -> DataFrame:
    fit = _fit(moments, level)
    base = F.col(level) == F.col(f"_first.{level}")
    inverse = safe_div(F.lit(1.0), F.col("n").cast("double"))
    base_inverse = safe_div(F.lit(1.0), F.col("_first.n").cast("double"))
    rows = fit.select(
        F.when(base, F.lit("(Intercept)")).otherwise(F.col(level).cast("string")).alias("term"),
        F.when(base, F.col("mean")).otherwise(F.col("mean") - F.col("_first.mean")).alias("estimate"),
        F.sqrt(F.col("ms_within") * F.when(base, inverse).otherwise(inverse + base_inverse)).alias("std_error"),
        safe_div("ss_between", F.col("ss_between") + F.col("ss_within")).alias("r_squared"),
        F.sqrt("ms_within").alias("sigma"),
        "df_resid",
        *more,
    )
    return rows.withColumn("t_value", safe_div("estimate", "std_error")).withColumn(
        "p_value", student_p(F.col("t_value"), F.col("df_resid").cast("double"))
    )


def positive(df: DataFrame, *names: str) -> DataFrame:
    """Rows on which the logarithm of every named column is finite."""
    for name in names:
        df = df.where(F.col(name) > 0)
    return df


def ols_factor_log(df: DataFrame, y: str, level: str) -> DataFrame:
    """The same on log(y); rows with y <= 0 have no logarithm and are counted in ``n_dropped``, in the pass that adds up."""
    log = F.ln(y)  # missing where there is none
    sums = df.groupBy(level).agg(
        F.count(log).alias("n"),
        F.avg(log).alias("mean"),
        (F.var_pop(log) * F.count(log)).alias("ss"),
        F.count_if(F.col(y) <= 0).alias("_dropped"),
    )
    counted = sums.withColumn("n_dropped", F.sum("_dropped").over(W.partitionBy(F.lit(0))))
    return _coefficients(counted.where((F.col("n") > 0) & F.col(level).isNotNull()).drop("_dropped"), level, "n_dropped")


def ols_factor_offset(df: DataFrame, fin: str, ini: str, level: str) -> DataFrame:
    """log(fin) on a factor with offset log(ini): the factor model of the log ratio.

    R squared is left out: with an offset it has no agreed meaning.
    """
    ratio = positive(df, fin, ini).withColumn("_ratio", F.ln(fin) - F.ln(ini))
    return ols_factor(ratio, "_ratio", level).drop("r_squared")


def ols_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of y on x: one row with both coefficients."""
    known = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = known.agg(
        F.count("*").alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        (F.var_pop(x) * F.count("*")).alias("_sxx"),
        (F.var_pop(y) * F.count("*")).alias("_syy"),
        (F.covar_pop(x, y) * F.count("*")).alias("_sxy"),
    )
    free = (F.col("n") - 2).cast("double")
    rest = F.col("_syy") - F.col("slope") * F.col("_sxy")
    fitted = (
        sums.withColumn("slope", safe_div("_sxy", "_sxx"))
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
        .withColumn("r_squared", safe_div(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy")))
        .withColumn(
            "sigma",
            F.sqrt(safe_div(F.greatest(F.lit(0.0), rest), F.when(free > 0, free))),
        )
        .withColumn("slope_se", safe_div("sigma", F.sqrt("_sxx")))
        .withColumn(
            "intercept_se",
            F.col("sigma")
            * F.sqrt(
                safe_div(F.lit(1.0), F.col("n").cast("double")) + safe_div(F.col("_mx") * F.col("_mx"), "_sxx")
            ),
        )
        .withColumn("slope_t", safe_div("slope", "slope_se"))
        .withColumn("intercept_t", safe_div("intercept", "intercept_se"))
    )
    tested = fitted.withColumns(
        {"slope_p": student_p(F.col("slope_t"), free), "intercept_p": student_p(F.col("intercept_t"), free)}
    )
    return tested.drop("_mx", "_my", "_sxx", "_syy", "_sxy")


def anova(df: DataFrame, y: str, level: str) -> DataFrame:
    """One-way analysis of variance as one row."""
    fit = _fit(level_moments(df, y, level), level)
    one = fit.select(
        (F.col("k") - 1).alias("df_between"),
        F.col("df_resid").alias("df_within"),
        "ss_between",
        "ss_within",
        safe_div("ss_between", (F.col("k") - 1).cast("double")).alias("ms_between"),
        "ms_within",
    ).distinct()
    return one.withColumn("f_value", safe_div("ms_between", "ms_within")).withColumn(
        "p_value",
        fisher_p(F.col("f_value"), F.col("df_between").cast("double"), F.col("df_within").cast("double")),
    )


def tukey(df: DataFrame, y: str, level: str, levels: Sequence, confidence: float = 0.95) -> DataFrame:
    """Honest significant differences of all pairs of levels (later minus earlier level)."""
    known = df.where(F.col(y).isNotNull() & F.col(level).isin(list(levels)))
    k = range(len(levels))
    of = [F.when(F.col(level) == v, F.col(y)) for v in levels]
    one = known.agg(
        *[F.count(of[i]).cast("double").alias(f"n{i}") for i in k],
        *[F.avg(of[i]).alias(f"m{i}") for i in k],
        *[F.coalesce(F.var_pop(of[i]) * F.count(of[i]), F.lit(0.0)).alias(f"s{i}") for i in k],
    )
    n = sum((F.col(f"n{i}") for i in k), F.lit(0.0))
    filled = sum((F.when(F.col(f"n{i}") > 0, 1.0).otherwise(0.0) for i in k), F.lit(0.0))
    free = n - filled
    ms = safe_div(sum((F.col(f"s{i}") for i in k), F.lit(0.0)), free)

    def fields(i: int, j: int) -> dict[str, Column]:
        diff = F.col(f"m{j}") - F.col(f"m{i}")
        scale = F.sqrt(ms / 2 * (safe_div(F.lit(1.0), f"n{i}") + safe_div(F.lit(1.0), f"n{j}")))
        return {"diff": diff, "_scale": scale, "q": safe_div(F.abs(diff), scale), "_k": filled, "df": free}

    tested = _pairs(one, levels, fields)
    point = range_quantile(F.lit(confidence), F.col("_k"), F.col("df"))
    return (
        tested.withColumns({"p_adjusted": range_p("q", "_k", "df"), "_half": point})
        .withColumns(
            {
                "ci_lower": F.col("diff") - F.col("_half") * F.col("_scale"),
                "ci_upper": F.col("diff") + F.col("_half") * F.col("_scale"),
                "df": F.col("df").cast("bigint"),
            }
        )
        .drop("_scale", "_k", "_half")
    )


def jarque_bera(df: DataFrame, y: str) -> DataFrame:
    """Normality from skewness and kurtosis over the whole table, not a sample of it."""
    known = df.where(F.col(y).isNotNull())
    one = known.agg(
        F.count("*").alias("n"), F.skewness(y).alias("skewness"), F.kurtosis(y).alias("excess_kurtosis")
    )
    s, k = F.col("skewness"), F.col("excess_kurtosis")
    statistic = F.col("n") / 6 * (s * s + k * k / 4)
    return one.withColumn("jb", statistic).withColumn("p_value", chi2_p(F.col("jb"), F.lit(2.0)))


def ks_normality(df: DataFrame, y: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of the whole table from the normal distribution with its mean and deviation.

    Equal values are one step of the distribution. The p-value is the asymptotic one of a given distribution, as the mean
    and deviation are taken from the table it is a bound from above. A constant column has no distance.
    """
    known = stored(df.where(F.col(y).isNotNull()).select(y))
    moments = known.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd")).select(F.struct("*")).scalar()
    z = safe_div(F.col(y) - moments["mean"], moments["sd"])
    below, upto, n = F.col("below_n"), F.col("below_n") + F.col("n"), F.col("total_n")
    at = value_positions(known, y).withColumn("_p", 1 - normal_upper(z))
    gap = F.greatest(safe_div(upto.cast("double"), n) - F.col("_p"), F.col("_p") - safe_div(below.cast("double"), n))
    one = at.agg(F.coalesce(F.max("total_n"), F.lit(0)).alias("n"), F.max(gap).alias("distance"))
    reach = F.sqrt("n") * F.col("distance")
    # Two series for the same limit, each of a few terms where it is used.
    small = F.sqrt(F.lit(2 * math.pi)) / reach * sum((F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * reach * reach)) for k in range(1, 5)), F.lit(0.0))
    large = 2 * sum(((-1.0) ** (k - 1) * F.exp(-2.0 * k * k * reach * reach) for k in range(1, 9)), F.lit(0.0))
    return one.withColumn("p_value", F.when(reach < 1, 1 - small).otherwise(large))


def factor_diagnostics(df: DataFrame, y: str, level: str, keys: Sequence[str]) -> DataFrame:
    """Per row: fitted value, residual, standardised residual, leverage and normal quantile.

    Levels hold one row each, so their table is small next to the data. Tied residuals share the
    quantile of their middle position.
    """
    known = stored(df.where(F.col(y).isNotNull() & F.col(level).isNotNull()).select(*keys, level, y))
    # Stored, so that its size is known and it is sent to the rows rather than the rows to a few levels.
    fit = stored(
        _fit(level_moments(known, y, level), level).select(
            F.col(level).alias("_level"), F.col("mean").alias("fitted"), F.col("n").alias("_n"), "ms_within"
        )
    )
    leverage = safe_div(F.lit(1.0), F.col("_n").cast("double"))
    resid = F.col(y) - F.col("fitted")
    # Row arithmetic on stored tables gives the same bits each time, so these rows need not be stored.
    rows = (
        known.join(fit, F.col(level) == F.col("_level"))
        .withColumns({"resid": resid, "leverage": leverage})
        .withColumn(
            "std_resid", safe_div("resid", F.sqrt(F.col("ms_within") * (1 - F.col("leverage"))))
        )
        .withColumn("scale_location", F.sqrt(F.abs("std_resid")))
        .select(*keys, level, "fitted", "resid", "std_resid", "scale_location", "leverage")
    )
    return with_theoretical_quantile(rows, "std_resid")


def line_diagnostics(df: DataFrame, y: str, x: str, keys: Sequence[str]) -> DataFrame:
    """The same for a straight line, where leverage grows with the distance from the mean of x."""
    known = stored(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, x, y))
    one = ols_line(known, y, x).select("slope", "intercept", "sigma", "n")
    centre = known.agg(F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    line = one.select(F.struct("*")).scalar()
    middle = centre.select(F.struct("*")).scalar()
    gap = F.col(x) - middle["mean"]
    rows = stored(
        known.withColumn("fitted", line["intercept"] + line["slope"] * F.col(x))
        .withColumns(
            {
                "resid": F.col(y) - F.col("fitted"),
                "leverage": safe_div(F.lit(1.0), line["n"].cast("double")) + safe_div(gap * gap, middle["sxx"]),
            }
        )
        .withColumn("std_resid", safe_div("resid", line["sigma"] * F.sqrt(1 - F.col("leverage"))))
        .withColumn("scale_location", F.sqrt(F.abs("std_resid")))
        .drop(x, y)
    )
    return with_theoretical_quantile(rows, "std_resid")


def with_theoretical_quantile(rows: DataFrame, value: str) -> DataFrame:
    """Normal quantile at the plotting position of each value."""
    n = F.col("total_n")
    a = F.when(n <= 10, 0.375).otherwise(0.5)
    position = (mid_rank() - a) / (n + 1 - 2 * a)
    placed = value_positions(rows, value).select(value, normal_quantile(position).alias("theoretical"), F.col("n").alias("_copies"))
    return join_weighted(rows, stored(placed), (value,), "_copies", F.xxhash64(*rows.columns)).drop("_copies")
