"""Order-processing tables read as a panel.

Supplier plays plot, return flag plays scenario, brand plays species, shipping year plays date and the
shipped quantity plays basal area. Cells of the sparse panel are the combinations that were shipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = list(range(1995, 2002))
RING = [(-4.5, 48.5), (2.5, 51.0), (8.0, 49.0), (7.0, 43.5), (3.0, 42.5), (-1.5, 43.3)]


# Column types as stored, so that opening a table costs no job to read file footers.
SCHEMAS = {
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _shipped_in(years) -> Column:
    """The year filter as date ranges, which reach the Parquet scan; a filter on year() would not."""
    date, rule = F.col("l_shipdate"), F.lit(False)
    for y in years:
        rule = rule | (
            (date >= F.lit(f"{y}-01-01").cast("timestamp_ntz"))
            & (date < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))
        )
    return rule


def cells(spark: SparkSession, folder: str, scenario: str | None = None, years=None) -> DataFrame:
    """Sparse panel, one row per shipped combination of a known plot and species, laid out by plot.

    Quantities are added up before the shuffle, so a supplier with very many shipments sends few rows.
    After it, a plot holds at most scenarios x species x dates rows and can be placed whole: the
    repartition by plot serves every later plot-wise aggregate and window.
    """
    lines = table(spark, folder, "lineitem").where(F.col("l_suppkey").isNotNull())
    if scenario is not None:
        lines = lines.where(F.col("l_returnflag") == scenario)
    if years is not None:
        lines = lines.where(_shipped_in(years))
    parts = table(spark, folder, "part").where(F.col("p_brand").isNotNull())
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("l_suppkey").alias("plot"),
            F.col("l_returnflag").alias("scenario"),
            F.col("p_brand").alias("species"),
            F.year("l_shipdate").alias("year"),
        )
        .agg(F.sum("l_quantity").alias("value"))
        .repartition("plot")
    )


def brand_number(c: str = "species") -> Column:
    return F.substring(F.col(c), 7, 10).cast("int")


def species_levels(spark: SparkSession, folder: str) -> list[str]:
    """All species, from the part table that lists them."""
    from ..operators.profile import levels_of

    return levels_of(table(spark, folder, "part"), "p_brand")


def species_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a table."""
    return table(spark, folder, "part").select(F.col("p_brand").alias("species")).distinct()


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Plot attributes; every 17th plot has no coordinates."""
    key = F.col("s_suppkey")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("plot"),
            F.col("r_name").alias("greco"),
            F.col("n_name").alias("ser"),
            F.col("s_acctbal").alias("alt"),
            F.when(key % 17 != 0, F.lit(-6.0) + (key * 37 % 160) / 10.0).alias("lon"),
            F.when(key % 17 != 0, F.lit(40.5) + (key * 53 % 120) / 10.0).alias("lat"),
        )
    )


def with_grades(panel: DataFrame) -> DataFrame:
    """Grade 1, 2, 3 or missing for each plot and species, and the species' Latin name."""
    k = (F.col("plot") * 7 + brand_number() * 3) % 10
    return panel.withColumns(
        {
            "grade": F.when(k < 5, 1).when(k < 8, 2).when(k < 9, 3),
            "species_latin": F.concat(F.lit("Species_"), brand_number().cast("string")),
        }
    )


def belts(spark: SparkSession, folder: str) -> DataFrame:
    """Belt of each species; every fourth species has none and is not listed."""
    remainder = brand_number() % 4
    return (
        table(spark, folder, "part")
        .select(F.col("p_brand").alias("species"))
        .distinct()
        .withColumn(
            "belt",
            F.when(remainder == 0, "montagnard").when(remainder == 1, "plaine").when(remainder == 2, "mediterraneen"),
        )
        .where(F.col("belt").isNotNull())
    )


def polygon(spark: SparkSession) -> DataFrame:
    points = ", ".join(f"('area', 1, {i}, {lon}D, {lat}D)" for i, (lon, lat) in enumerate(RING))
    return spark.sql(f"SELECT * FROM VALUES {points} AS ring(region, ring_id, seq, lon, lat)")


# Regions that overlap the outline and each other; the second has a hole.
REGIONS = {
    "north": [[(-6.0, 46.2), (9.5, 46.2), (9.5, 52.0), (-6.0, 52.0)]],
    "ringed": [[(-2.0, 43.0), (6.0, 44.0), (5.0, 50.0), (-3.0, 49.0)], [(0.0, 45.0), (3.0, 45.0), (3.0, 47.5), (0.0, 47.5)]],
    "islands": [[(-5.0, 41.0), (-4.0, 41.0), (-4.5, 42.0)], [(7.0, 41.0), (9.4, 41.2), (8.0, 43.1)]],
}


def regions(spark: SparkSession) -> DataFrame:
    """The outline and the regions above as one table."""
    rows = [(name, r, i, *p) for name, rings in REGIONS.items() for r, ring in enumerate(rings) for i, p in enumerate(ring)]
    return polygon(spark).unionByName(spark.createDataFrame(rows, "region string, ring_id int, seq int, lon double, lat double"))
