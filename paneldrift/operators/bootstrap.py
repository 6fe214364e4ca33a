"""Bootstrap of a difference of rank correlations between two sides of every group.

A draw picks one of the n rows of its (group, side) by number, rows being numbered by value and grade. A resample is told by how
often each distinct value and grade was drawn, so no draw leaves the task that makes it:

1. Values are put in order once, with their counts per grade, and cut into blocks of at most STEPS distinct values.
2. Each iteration's n draws are dealt over the blocks, by one multinomial draw per iteration (all of them to the only block
   of a group that has one), which also tells how many draws lie below each block.
3. A task has a block and some iterations, or several of them as long as their counts are few: it hashes the draws, counts them per
   value and grade, ranks them from the counts below, and sends the sums that make a rank correlation, a few numbers per iteration.
   The number of tasks follows the counts they are sent, so what one of them holds does not grow with the data.

Draws are hashes of seed, group, side, iteration and block, so any run, order or retry draws the same.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import safe_div
from ..session import stored
from .ordering import value_positions

# Ship the helpers with the functions, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct values of a block, iterations and draws that a task takes at a time, draws held in memory, and counts of blocks sent to a task, about.
STEPS, ITERATIONS, DRAWS, PIECE, COUNTS = 1 << 16, 250, 50_000_000, 1 << 19, 1 << 20

# Increment and multipliers of the published generator splitmix64.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def seed_of(*parts) -> int:
    """64 bits from the text of the parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def drawn(seeds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Draw number 1, 2, ... of each seed, 64 bits."""
    x = seeds + numbers.astype(np.uint64) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def dealt(key: str, sizes: list[int], iterations: range) -> np.ndarray:
    """How many draws of each iteration fall in each block: rows are iterations."""
    total = sum(sizes)
    if len(sizes) == 1:
        return np.full((len(iterations), 1), total)
    share = np.array(sizes, float) / total
    return np.array([np.random.Generator(np.random.PCG64(seed_of(key, i))).multinomial(total, share) for i in iterations])


def resampled(key: str, block: int, total: int, counts: np.ndarray, iterations: range, draws: np.ndarray, below: np.ndarray):
    """Sums over one block for every iteration: draws per grade, their rank deviations, and squared deviations of all.

    ``counts`` has the rows per distinct value, in order, and grade. ``draws`` and ``below`` tell each iteration's draws in
    the block and before it.
    """
    steps, grades = counts.shape
    edges, centre = np.cumsum(counts.ravel()), (total + 1) / 2
    size, out, at = np.uint64(edges[-1]), [], 0
    while at < len(iterations):
        # As many iterations as fit, one at least, whose draws may come in several pieces.
        fit = max(1, min(int(np.searchsorted(np.cumsum(draws[at:]), PIECE, "right")), PIECE // (steps * grades)))
        some, number = draws[at : at + fit], iterations[at : at + fit]
        seeds = np.array([seed_of(key, i, block) for i in number], np.uint64)
        hist = np.zeros(fit * steps * grades, np.int64)
        done = 0
        while done < max(1, int(some.max())):
            take = np.clip(some - done, 0, PIECE)
            row = np.repeat(np.arange(fit), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            cell = np.searchsorted(edges, (drawn(seeds[row], place + done + 1) % size).astype(np.int64), "right")
            hist += np.bincount(row * (steps * grades) + cell, minlength=len(hist))
            done += PIECE
        hist = hist.reshape(fit, steps, grades)
        tied = hist.sum(axis=2)
        away = below[at : at + fit, None] + np.cumsum(tied, axis=1) - tied + (tied + 1) / 2 - centre
        out.append((hist.sum(axis=1), np.einsum("isg,is->ig", hist, away), np.einsum("is,is,is->i", tied, away, away)))
        at += fit
    return tuple(np.concatenate(x) for x in zip(*out))


def bootstrap_diff(
    df: DataFrame,
    group: str,
    side: str,
    value: str,
    grade: str,
    grades: Sequence,
    sides: Sequence[str] = (labels.MONO, labels.PLURI),
    n_iter: int = 5000,
    least: int = 10,
    seed: int = 0,
) -> DataFrame:
    """One row per group and iteration: correlation of the first side minus that of the second.

    Groups with fewer than ``least`` rows on a side are left out. The difference is null when a resample is constant.
    """
    first_side, second_side = sides
    k = range(len(grades))
    known = stored(
        df.where(F.col(value).isNotNull() & F.col(grade).isin(list(grades)) & F.col(side).isin(list(sides)))
        .select(group, side, value, grade)
    )
    per_side = known.groupBy(group).agg(*[F.count_if(F.col(side) == s).alias(f"_n{i}") for i, s in enumerate(sides)])
    enough = stored(per_side.where((F.col("_n0") >= least) & (F.col("_n1") >= least)).select(group))
    held = known.join(enough, group, "left_semi")
    steps = value_positions(held, value, [group, side], {f"n{i}": F.count_if(F.col(grade) == g) for i, g in enumerate(grades)})
    below = sum((F.col(f"below_n{i}") for i in k), F.lit(0))
    total = sum((F.col(f"total_n{i}") for i in k), F.lit(0))
    numbered = steps.select(group, side, below.alias("_below"), total.alias("_total"), F.array(*[F.col(f"n{i}") for i in k]).alias("_n"))
    # A block's values begin within one stretch of STEPS rows, so there are STEPS at most.
    place = [group, side, "_block"]
    blocks = stored(
        numbered.withColumn("_block", F.floor(F.col("_below") / STEPS))
        .groupBy(*place, "_total")
        .agg(F.array_sort(F.collect_list(F.struct("_below", "_n"))).alias("_steps"))
        .withColumn("_counts", F.flatten(F.col("_steps._n")))
        .withColumn("_size", F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, n: a + n))
        .select(*place, "_total", "_size", F.size("_counts").alias("_long"), "_counts")
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col(side).cast("string"))
    by_step = F.greatest(F.lit(1), F.least(F.lit(ITERATIONS), F.floor(F.lit(DRAWS) / F.max("_size")))).cast("int")
    listed = F.array_sort(F.collect_list(F.struct("_block", "_size"))).alias("_blocks")
    grouped = blocks.groupBy(group, side).agg(listed, by_step.alias("_step"), F.sum("_long").alias("_long"))
    sent = grouped.agg(F.sum(F.col("_long") * F.ceil(F.lit(n_iter) / F.col("_step")))).first()[0] or 0
    jobs = (
        grouped.withColumn("_from", F.explode(F.expr(f"sequence(1, {n_iter}, _step)")))
        .select(group, side, key.alias("_key"), "_blocks", "_from", F.least(F.col("_from") + F.col("_step"), F.lit(n_iter + 1)).alias("_to"))
        .repartition(tasks, group, side, "_from")
    )
    kinds = {n: df.schema[n].dataType.simpleString() for n in (group, side)}
    ids = f"`{group}` {kinds[group]}, `{side}` {kinds[side]}"

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for i, row in enumerate(batch.select(["_key", "_blocks", "_from", "_to"]).to_pylist()):
                sizes = [b["_size"] for b in row["_blocks"]]
                got = dealt(row["_key"], sizes, range(row["_from"], row["_to"]))
                under = np.cumsum(got, axis=1) - got
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array([i] * n)) for c in (group, side, "_key", "_from")),
                        pa.array([b["_block"] for b in row["_blocks"]], pa.int64()),
                        pa.array(list(got.T), pa.list_(pa.int64())),
                        pa.array(list(under.T), pa.list_(pa.int64())),
                    ],
                    [group, side, "_key", "_from", "_block", "_draws", "_under"],
                )

    def draw(batches):
        import pyarrow as pa

        width = len(grades)
        for batch in batches:
            for i in range(batch.num_rows):
                # One row at a time, and its lists as arrays: a block's counts are many.
                key, block, total, first = (batch.column(c)[i].as_py() for c in ("_key", "_block", "_total", "_from"))
                draws, under, counts = (batch.column(c)[i].values.to_numpy() for c in ("_draws", "_under", "_counts"))
                number = range(first, first + len(draws))
                n, s, ss = resampled(key, block, total, counts.reshape(-1, width), number, draws, under)
                m = len(number)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array([i] * m)) for c in (group, side)),
                        pa.array(number, pa.int32()),
                        *(pa.array(n[:, j], pa.int64()) for j in range(width)),
                        *(pa.array(s[:, j], pa.float64()) for j in range(width)),
                        pa.array(ss, pa.float64()),
                    ],
                    [group, side, "iteration", *(f"n{j}" for j in range(width)), *(f"s{j}" for j in range(width)), "ss"],
                )

    shares = jobs.mapInArrow(deal, f"{ids}, _key string, _from int, _block bigint, _draws array<bigint>, _under array<bigint>")
    work = shares.join(blocks.select(*place, "_total", "_counts"), place).repartition(max(tasks, math.ceil(sent / COUNTS)), *place, "_from")
    columns = ", ".join([*(f"n{j} bigint" for j in k), *(f"s{j} double" for j in k), "ss double"])
    parts = work.select(group, side, "_key", "_from", "_block", "_draws", "_under", "_total", "_counts").mapInArrow(draw, f"{ids}, iteration int, {columns}")
    sums = parts.groupBy(group, side, "iteration").agg(*[F.sum(c).alias(c) for c in [*(f"n{j}" for j in k), *(f"s{j}" for j in k), "ss"]])
    centre = (sum((F.col(f"n{j}") for j in k), F.lit(0)) + 1) / 2
    # Mid-rank of a grade: draws of lower grades plus the middle of its own.
    away = [sum((F.col(f"n{j}") for j in range(i)), F.lit(0)) + (F.col(f"n{i}") + 1) / 2 - centre for i in k]
    across = sum((away[i] * F.col(f"s{i}") for i in k), F.lit(0.0))
    squares = sum((away[i] * away[i] * F.col(f"n{i}") for i in k), F.lit(0.0))
    rho = safe_div(across, F.sqrt("ss") * F.sqrt(squares))
    both = sums.select(group, side, "iteration", F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))
    return both.groupBy(group, "iteration").agg(
        (F.max(F.when(F.col(side) == first_side, F.col("rho"))) - F.max(F.when(F.col(side) == second_side, F.col("rho")))).alias("diff")
    )


def bootstrap_summary(replicates: DataFrame, group: str, level: float = 0.95) -> DataFrame:
    """Mean, percentile interval and significance per group; undefined replicates are skipped.

    A group holds one row per iteration, a number set by the caller, so its exact percentile is one
    small aggregate.
    """
    tail = (1 - level) / 2
    bounds = F.percentile("diff", F.array(F.lit(tail), F.lit(1 - tail)))
    return (
        replicates.groupBy(group)
        .agg(F.avg("diff").alias("mean_diff"), bounds.alias("_ci"))
        .select(group, "mean_diff", F.col("_ci")[0].alias("ci_lower"), F.col("_ci")[1].alias("ci_upper"))
        .withColumn("significant", labels.excludes_zero("ci_lower", "ci_upper"))
    )
