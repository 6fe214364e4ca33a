"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document's size is its number of words. The targets share the words of all documents by the sources' weights;
no target exceeds `most` times its source, and what is above is shared again among the others by weight. Every
document of a source is expected target / source size times. Documents are laid out in each source by size, the
expected copies are summed along that order, one random offset per source is added, and a document is taken once
for each whole number its interval crosses. As sizes rise along the order within a class of near sizes, the words taken
stay near the target.

The running sums need no task that holds a source: a source is divided in cells (class of sizes x part by hash of
doc_id), cells are counted first, the cells' sums give each cell its start, and rows are numbered within their cell.

Defined results: a null text has size 0; the null source is a source of its own and comes last; a source without words has
target 0 and nothing is taken; repeated rows count each; a null doc_id hashes as an empty string; an empty table gives
an empty one. Only doc_id, text and source are read; other columns are kept by `mix` and ignored by `shares`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240
#: Parts of each class of sizes, so that a hot source or many equal documents spread over tasks.
PARTS = 256

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(text: Column) -> Column:
    """32 bits of md5, the same number in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _size_class(size: Column) -> Column:
    """Rises with size: its number of binary digits, then the four digits after the first, so sizes of a class differ by a 16th."""
    digits = F.char_length(F.bin(size))
    return digits * 16 + F.call_function("shiftright", size, F.greatest(digits - 5, F.lit(0))).bitwiseAND(F.lit(15)).cast("int")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target.

    One row per source: ordered by limit / weight, the sources at their limit are the first ones, up to the first
    place where the level of the rest is not above the next source's limit.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sources.select("source", "source_size", weight.cast("bigint").alias("weight"))
    by_limit = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every, before = W.partitionBy(), by_limit.rowsBetween(W.unboundedPreceding, -1)
    # The level with all sources before this one at their limit; sums are of whole numbers and so exact.
    used = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - used) / rest
    rows = rows.withColumns({"level": level, "place": F.row_number().over(by_limit)})
    free = F.col("level") * F.col("weight") <= F.col("source_size") * most
    rows = rows.withColumn("stop", F.min_by("level", F.when(free, F.col("place"))).over(every))
    target = F.least(F.col("stop") * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def shares(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, keep=()) -> DataFrame:
    """doc_id, size, source_size, target, copies (and the columns in `keep`) for every row of docs."""
    part = _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % PARTS
    # A key without nulls, so that cells, windows and the join share one layout.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    sized = docs.select("doc_id", key.alias("key"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), part.alias("part"), *keep)
    sized = sized.withColumn("class", _size_class(F.col("size")))
    cells = sized.groupBy("key", "class", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    # Cells of a source are bounded: some 300 classes x PARTS. Their sums place every cell in its source.
    name = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source")
    wanted = targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")).select(name, "source_size"), weights, most)
    wanted = wanted.select(key.alias("key"), "source_size", "target")
    order = W.partitionBy("key").orderBy("class", "part")
    start = F.coalesce(F.sum("rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cells.select("key", "class", "part", start.alias("start")).join(wanted, "key")
    number = F.row_number().over(W.partitionBy("key", "class", "part").orderBy("size", "doc_id", "tie"))
    rows = sized.withColumn("number", number).join(placed, ["key", "class", "part"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A multiple of 2**-20, so that adding it to a whole number is exact.
    offset = (_hash(F.concat_ws("|", F.lit(str(seed)), F.substring("key", 2, 1 << 30))) % (1 << 20)) / float(1 << 20)
    upto = lambda n: F.floor(n * F.col("expected") + F.col("offset"))
    place = F.col("start") + F.col("number")
    rows = rows.withColumns({"expected": expected, "offset": offset})
    return rows.select("doc_id", "size", "source_size", "target", F.least(upto(place) - upto(place - 1), F.lit(most)).alias("copies"), *keep)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its columns."""
    names = docs.columns
    inner = docs.select("doc_id", "text", "source", F.struct(*(docs[n] for n in names)).alias("_row"))
    taken = shares(inner, keep=("_row",), **options).where(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
