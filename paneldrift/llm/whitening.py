"""Whitening of embeddings by a covariance that weighs each distinct vector by its number of copies.

1. `quantised` turns components into integers, so equal vectors are equal exactly.
2. Identical vectors are folded to one row with their count before the shuffle; every later step sees a vector once.
3. Sums per dimension are exact integers. Each task then centres its distinct vectors, (n x - S) / n with an exact
   numerator, and multiplies them, weighted, in one matrix product a batch; the products of the tasks are added up. Only
   dimension x dimension numbers reach the driver, for the eigenvectors.
4. Each distinct vector is projected once, and the results are joined back to the rows, heavy vectors over several tasks.

Weights are the counts (all vectors are the fit list) or one (each distinct vector once). Memory grows with the square of the
dimension only.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those of another
length than most vectors have (ties: the longer), unless `dimension` names the length; null and repeated vec_ids are rows like
any other; components whose eigenvalue is within rounding of zero are left out, so equal vectors alone give no row; extra
columns are ignored; an empty table gives an empty one. `deviation` is exact up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.operators.enrich import join_weighted
from paneldrift.session import stored

#: Vectors that a task turns into a matrix at a time.
ROWS = 2048


def quantised(df: DataFrame, scale: int = 1024, shift: int = 100_000, dimension: int | None = None) -> DataFrame:
    """vec_id and x, the components as integers, of all vectors that take part."""
    known = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("bigint"))
    rows = df.where(F.coalesce(known, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("x"), F.size("embedding").alias("_size"))
    if dimension is None:
        sizes = rows.where("_size > 0").groupBy("_size").agg(F.count("*").alias("n"))
        dimension = sizes.agg(F.max_by("_size", F.struct("n", "_size"))).scalar()
    return rows.where(F.col("_size") == dimension).drop("_size")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _folded(df: DataFrame, value: str, work: Callable, kind: str) -> np.ndarray:
    """Sum over all tasks of the matrices that `work` makes of (rows, weights); `value` and `weight` are columns of df.

    A task adds its batches up, so it sends one matrix, cell by cell, and cells are added before they are shuffled.
    """

    def summed(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                piece = batch.slice(i, ROWS)
                part = work(_matrix(piece.column(value)), piece.column("weight").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            for i, row in enumerate(np.atleast_2d(total)):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(row)), pa.array(range(len(row))), pa.array(row.tolist())], ["i", "j", "v"])

    cells = df.select(value, "weight").mapInArrow(summed, f"i bigint, j bigint, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = cells.orderBy("i", "j").collect()  # dimension x dimension at most
    return np.array([r["v"] for r in found]).reshape(-1, 1 + max((r["j"] for r in found), default=0)) if found else np.empty((0, 0))


def _weighted_sums(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight @ x


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as whole numbers of any size, and x - S / n."""
    whole = x.astype(object) * n - np.array(sums, dtype=object)
    return whole, (whole / n).astype(np.float64)


def whiten(df: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, weigh: str = "count", dimension: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component.

    n is the total weight; `whitened` has mean 0, variance 1 and no correlation over the fit list, and `identity_error` is the
    largest entry of its covariance minus the identity, computed from the whitened vectors.
    """
    if weigh not in ("count", "one"):
        raise ValueError("weigh is 'count' or 'one'")
    spark = df.sparkSession
    rows = stored(quantised(df, scale, shift, dimension))
    # Copies of a vector are folded in the tasks that read them.
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("copies")))
    fit = distinct.withColumn("weight", F.col("copies") if weigh == "count" else F.lit(1).cast("bigint"))
    n = fit.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    result = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], result)
    sums = [int(s) for s in _folded(fit, "x", _weighted_sums, "bigint").ravel()]

    def products(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        _, c = centred(x, n, sums)
        return (c * weight[:, None]).T @ c

    covariance = _folded(fit, "x", products, "double") / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    order = order[values[order] > values.max() * len(sums) * np.finfo(np.float64).eps]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    if not len(values):
        return spark.createDataFrame([], result)

    def projected(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                piece = batch.slice(i, ROWS)
                whole, c = centred(_matrix(piece.column("x")), n, sums)
                far = [str(v) for v in (whole * whole).sum(axis=1)]
                out = (c @ vectors) / np.sqrt(values)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("x"), piece.column("copies"), piece.column("weight"), pa.array(far), pa.array(list(out), pa.list_(pa.float64()))],
                    ["x", "copies", "weight", "far", "whitened"],
                )

    made = fit.mapInArrow(projected, "x array<bigint>, copies bigint, weight bigint, far string, whitened array<double>")
    white = stored(made.withColumn("deviation", F.expr("try_cast(far AS decimal(38,0))")).drop("far"))
    mean = _folded(white, "whitened", _weighted_sums, "double").ravel() / n

    def spread(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return ((y - mean) * weight[:, None]).T @ (y - mean)

    error = float(np.abs(_folded(white, "whitened", spread, "double") / n - np.eye(len(values))).max())
    explained = F.array(*(F.lit(float(v / trace)) for v in values))
    joined = join_weighted(rows, white.select("x", "copies", "deviation", "whitened"), ["x"], "copies")
    long = joined.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return long.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("_k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
