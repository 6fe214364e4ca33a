"""Column helpers that settle missing values and division once for the whole library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero or missing."""
    return F.try_divide(col(a), col(b))


def nan_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(float("nan")))


def sum_or_zero(c: str | Column, window: WindowSpec | None = None) -> Column:
    """Sum, over a window if given, in which nothing adds up to zero."""
    total = F.sum(col(c))
    return F.coalesce(total if window is None else total.over(window), F.lit(0.0))


def is_any(c: str | Column, values) -> Column:
    """Membership that is false, never null, for a missing value."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def row_total(columns) -> Column:
    """Sum across columns with missing cells counted as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in columns])


def once(value: Column, rows: Column, message: str) -> Column:
    """The aggregated value, or an error when more than one row fed the cell."""
    return F.when(rows > 1, F.raise_error(F.lit(message))).otherwise(value)


def words(*parts: str | Column, sep: str = " ") -> Column:
    """Join parts as text; a missing part is printed as NA."""
    return F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts])


def short_number(c: str | Column, digits: int = 2) -> Column:
    """Half-even rounding printed without a trailing .0"""
    return F.regexp_replace(F.bround(col(c), digits).cast("string"), r"\.0$", "")


def draw_hash(*parts: str | Column) -> Column:
    """60-bit number from the parts: the same draw on every engine and every run."""
    key = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def order_hash(*parts: str | Column) -> Column:
    """Pseudo-random sort key, evenly spread whatever the keys look like."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]).cast("binary"))
