"""Ranks, positions and exact quantiles without gathering a group in one task.

A plain ranking window sends a whole group to one task, and the groups here are few and large (three
grades, six belt-by-type groups, or no grouping at all). Instead:

1. bounds between buckets of about equally many rows are taken from a quantile sketch, in groups larger than a bucket;
2. rows move once, to the task of their group and bucket, where equal values are folded;
3. counts below a value are the counts of the earlier buckets of its group, one row per bucket and group, plus a running
   sum within the bucket.

Single quantiles need no order of the whole table: ``selected_positions`` counts bins and looks into a few of them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col, order_hash
from ..session import stored
from .enrich import join_null_safe, join_weighted


def with_positions(rows: DataFrame, value: str, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Add ``below_<c>`` and ``total_<c>`` for every count column ``c``, in the order of any sortable value.

    ``rows`` must hold each value once per group. ``below_<c>`` sums ``c`` over smaller values of the
    group, ``total_<c>`` over the group. The rows are range-partitioned by (group, value) and stored with the number of
    their partition. Numbers, of which there may be very many, are placed by ``value_positions`` at less cost.
    """
    ranged = stored(rows.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))

    # A few rows per partition of the range: their window is small even without grouping columns.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in counts])
    heads = sums.select(
        *by,
        "_part",
        F.lit(0).alias("_kind"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in counts],
        *[F.sum(c).over(group).alias(f"total_{c}") for c in counts],
    )
    # What lies before a partition enters its running sum as the first row: no join of the two tables.
    lines = ranged.withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    before = W.partitionBy("_part", *by).orderBy("_kind", value).rowsBetween(W.unboundedPreceding, -1)
    running = lines.withColumns(
        {f"below_{c}": F.sum(c).over(before) for c in counts}
        | {f"total_{c}": F.max(f"total_{c}").over(before) for c in counts}
    )
    return running.where(F.col("_kind") == 1).select(
        *rows.columns, *[f"{kind}_{c}" for kind in ("below", "total") for c in counts]
    )


# Rows of a bucket of values, about, and buckets at most: beyond that, buckets grow. Bounds are searched in steps of CHUNK.
BUCKET, BUCKETS, CHUNK = 1 << 17, 1000, 32


def _with_bucket(known: DataFrame, value: str, by: Sequence[str]) -> tuple[DataFrame, bool]:
    """Add ``_bucket``, which ascends with the value within the group, and whether any group has more than one.

    Bounds of groups larger than a bucket come from one quantile sketch. Between two bounds lie about as many rows as a bucket
    has; a bound itself is a bucket of its own with an odd number, and every value with more rows than a bucket is a bound.
    """
    sizes = known.groupBy(*by).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    block = max(BUCKET, math.ceil(total / BUCKETS))
    parts = math.ceil(most / block)
    if parts < 2:
        return known.withColumn("_bucket", F.lit(0)), False
    large = known
    if by:
        large = join_null_safe(known, F.broadcast(sizes.where(F.col("_n") > block)), by, "inner")
    sketch = F.percentile_approx(value, [i / parts for i in range(1, parts)], 20 * parts)
    cuts = large.groupBy(*by).agg(F.array_sort(F.array_distinct(sketch)).alias("_cuts"))
    # The last bound of every chunk tells the chunk, so that a row is compared with few bounds.
    steps = F.sequence(F.lit(CHUNK), F.size("_cuts"), F.lit(CHUNK))
    tops = F.when(F.size("_cuts") < CHUNK, F.slice("_cuts", 1, 0)).otherwise(F.transform(steps, lambda i: F.element_at("_cuts", i)))
    cuts = stored(cuts.withColumn("_tops", tops))  # one row per large group, of which there are BUCKETS at most
    v = F.col(value)
    ahead = CHUNK * F.size(F.filter("_tops", lambda c: c < v))
    rows = join_null_safe(known, F.broadcast(cuts) if by else cuts, by).withColumn("_ahead", ahead)
    under = F.col("_ahead") + F.size(F.filter(F.slice("_cuts", F.col("_ahead") + 1, CHUNK), lambda c: c < v))
    rows = rows.withColumn("_under", under)
    at = F.coalesce(F.try_element_at("_cuts", F.col("_under") + 1) == v, F.lit(False)).cast("int")
    bucket = F.when(F.col("_cuts").isNull(), 0).otherwise(2 * F.col("_under") + at)
    return rows.withColumn("_bucket", bucket).drop("_cuts", "_tops", "_ahead", "_under"), True


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct known values of each group with counts, counts below (``below_<c>``) and group totals (``total_<c>``).

    Rows move once, to the task of their group and bucket of values, where equal values are folded and summed up in order.
    Buckets of one value do not move at all: their sums are their only row. ``df`` is read several times, so it should be a
    stored table.
    """
    counts = dict(counts or {"n": F.count("*")})
    names = [f"{kind}_{c}" for kind in ("below", "total") for c in counts]
    bucketed, several = _with_bucket(df.where(F.col(value).isNotNull()), value, by)
    place = [*by, "_bucket"]
    if not several:
        folded = bucketed.repartition(*(by or [F.lit(0)])).groupBy(*by, value).agg(*[c.alias(n) for n, c in counts.items()])
        group = W.partitionBy(*(by or [F.lit(0)]))
        before = group.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return folded.withColumns(
            {f"below_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in counts}
            | {f"total_{c}": F.sum(c).over(group) for c in counts}
        ).select(*by, value, *counts, *names)
    sums = bucketed.groupBy(*place).agg(F.max(value).alias("_value"), *[c.alias(n) for n, c in counts.items()])
    group = W.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # One row per group and bucket.
    heads = stored(
        sums.withColumns(
            {f"below_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in counts}
            | {f"total_{c}": F.sum(c).over(group) for c in counts}
        )
    )
    alone = heads.where(F.col("_bucket") % 2 == 1).select(*by, F.col("_value").alias(value), *counts, *names)
    moved = bucketed.where(F.col("_bucket") % 2 == 0).repartition(*place)
    folded = moved.groupBy(*place, value).agg(*[c.alias(n) for n, c in counts.items()])
    before = W.partitionBy(*place).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    running = folded.withColumns({f"_run_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in counts})
    placed = join_null_safe(running, heads.select(*place, *names), place, "inner")
    placed = placed.withColumns({f"below_{c}": F.col(f"below_{c}") + F.col(f"_run_{c}") for c in counts})
    return placed.select(*by, value, *counts, *names).unionByName(alone)


def mid_rank(n: str | Column = "n", below: str | Column = "below_n") -> Column:
    """Average rank of tied values: the numbers below plus the middle of the tie."""
    return col(below) + (col(n) + 1) / 2


def with_mid_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add the mid-rank of each row within its group; rows without a value get none.

    The rows are stored first, so that the values joined on are the very ones that were ranked. Ranks go back to as many
    tasks as a value has blocks of rows.
    """
    kept = stored(df)
    ranks = stored(value_positions(kept, value, by).select(*by, value, mid_rank().alias(name), F.col("n").alias("_copies")))
    return join_weighted(kept, ranks, (value, *by), "_copies").drop("_copies")


def numbered(df: DataFrame, by: Sequence[str], order: Column, name: str = "number") -> DataFrame:
    """Number the rows of each group 1..n by a key that is unique in the group, and add the group size."""
    keyed = df.withColumns({"_order": order, "_one": F.lit(1).cast("bigint")})
    placed = with_positions(keyed, "_order", by, ["_one"])
    return placed.select(
        *df.columns, (F.col("below__one") + 1).alias(name), F.col("total__one").alias("group_size")
    )


def quantiles_of(
    positions: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float], extra: Sequence[Column] = ()
) -> DataFrame:
    """Linearly interpolated quantiles from the positions of the values around them, by one mergeable aggregate."""
    where = {name: (F.col("total_n") - 1) * F.lit(float(p)) for name, p in probs.items()}

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("below_n") <= index) & (index < F.col("below_n") + F.col("n")), F.col(value)))

    found = positions.groupBy(*by).agg(
        *[at(F.floor(h)).alias(f"_lo_{name}") for name, h in where.items()],
        *[at(F.ceil(h)).alias(f"_hi_{name}") for name, h in where.items()],
        F.max("total_n").alias("n"),
        *extra,
    )
    result = {}
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result[name] = low + (high - low) * (h - F.floor(h))
    return found.withColumns(result).drop(*[f"_{s}_{name}" for s in ("lo", "hi") for name in probs])


# Bins that a range of values is divided into, and the largest value that bins tell apart.
BINS, MOST = 4096, 1.7e308


def selected_positions(
    kept: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float], groups: DataFrame | None = None
) -> DataFrame:
    """``value_positions`` of the values around the wanted quantiles only, without sorting or moving the other rows.

    One aggregate counts the rows of BINS equal ranges of values per group; the bins that hold a wanted position are
    folded to their distinct values, and divided again as long as one of them has more than BUCKET. ``kept`` is a stored
    table of known values. ``groups`` may give its number of rows, least and largest value as ``n``, ``min``, ``max``.
    """
    if groups is None:
        groups = stored(kept.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")))

    def half(c: str) -> Column:  # of a value as a finite double, so that no difference overflows
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col(c).cast("double"))) / 2

    ranges = groups.where(F.col("n") > 0).select(
        *by, F.lit(0).alias("_cell"), F.col("n").alias("total_n"), half("min").alias("_low"), half("max").alias("_high"),
        F.lit(0).cast("bigint").alias("_below"),
    )
    rows = kept.select(*by, value, F.lit(0).alias("_cell"), F.lit(1).cast("bigint").alias("n"))
    place = [*by, "_cell"]
    apart = F.try_divide(half(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    bin_ = F.least(F.floor(F.coalesce(apart, F.lit(0.0)) * BINS).cast("int"), F.lit(BINS - 1))
    wanted_at = [f(F.lit(float(p)) * (F.col("total_n") - 1)) for p in probs.values() for f in (F.floor, F.ceil)]
    held = reduce(lambda a, b: a | b, [(F.col("_below") <= i) & (i < F.col("_below") + F.col("_rows")) for i in wanted_at])
    keys = list(by)  # at first there is one cell per group
    while True:
        met = join_null_safe(rows.drop("_cell") if keys != place else rows, ranges, keys, "inner")
        binned = met.withColumn("_bin", bin_)
        counted = binned.groupBy(*place, "_bin", "total_n", "_below").agg(
            F.sum("n").alias("_rows"), F.min(half(value)).alias("_least"), F.max(half(value)).alias("_most")
        )
        before = W.partitionBy(*place).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        found = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(held)
        number = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_cell", "_bin"))
        cells = stored(found.withColumn("_next", number))  # a few rows per group
        kept_bins = cells.select(*place, "_bin", "_next")
        inside = join_null_safe(binned.select(*place, "_bin", value, "n"), kept_bins, (*place, "_bin"), "inner")
        rows = inside.groupBy(*by, F.col("_next").alias("_cell"), value).agg(F.sum("n").alias("n"))
        ranges = cells.select(
            *by, F.col("_next").alias("_cell"), "total_n", F.col("_least").alias("_low"), F.col("_most").alias("_high"), "_below"
        )
        if cells.where((F.col("_rows") > BUCKET) & (F.col("_least") < F.col("_most"))).isEmpty():
            break
        rows, keys = stored(rows), place  # some bin has many rows; how many values, if they are not all one?
        widest = rows.groupBy(*place).agg(F.count("*").alias("values")).where(F.col("values") > BUCKET)
        if join_null_safe(widest, ranges, place, "inner").where(F.col("_low") < F.col("_high")).isEmpty():
            break
    before = W.partitionBy(*place).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    running = rows.withColumn("_run", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = join_null_safe(running, ranges, place, "inner")
    return placed.select(*by, value, "n", (F.col("_below") + F.col("_run")).alias("below_n"), "total_n")


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles of each group's known values, by selection."""
    kept = stored(df.where(F.col(value).isNotNull()).select(*by, value))
    return quantiles_of(selected_positions(kept, value, by, probs), value, by, probs)


def top_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n largest rows and all rows tied with the last of them; missing values come last.

    The n-th value is found by a distributed top-n, the rows by a filter: no global ranking. The rows are stored
    first, so that both see the same bits of the value.
    """
    df = stored(df)
    last = (
        df.select(value)
        .orderBy(F.desc_nulls_last(value))
        .limit(n)
        .agg(F.struct(F.min(value).alias("value"), F.bool_or(F.col(value).isNull()).alias("missing")).alias("last"))
        .scalar()
    )
    return df.where((F.col(value) >= last["value"]) | last["missing"])


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones for the same seed."""
    return df.orderBy(order_hash(F.lit(seed), *key), *key).limit(n)

