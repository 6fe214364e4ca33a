"""Schemas of the input tables and the mapping from source column names to canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null


KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _struct(spec: str) -> T.StructType:
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in fields])


# Index-year panel (dates 1..100, Latin species names, coordinates on every row).
PANEL_M = _struct(
    "sim_id string, plot string, scenario string, lon double, lat double, species string, year int, value double"
)
# Calendar-year panel (dates 2001..2100, species codes, explicit zeros).
PANEL_P = _struct("plot string, scenario string, year int, species string, value double")
GRADE_M = _struct(
    "sim_id string, plot string, scenario string, lon double, lat double, species string, year int, value double, "
    "grade int"
)
GRADE_P = _struct(
    "plot string, scenario string, year int, species string, value double, species_latin string, "
    "grade_code string, grade int"
)
SITE = _struct(
    "plot string, lat double, lon double, greco string, ser string, rum_90cm double, fertility_score string, "
    "alt double, mean_diameter double, top_height double, top_age double, large_stems int, medium_stems int, "
    "small_stems int, young_stems int"
)
BELT = _struct("species string, belt string")
POLYGON = _struct("region string, ring_id int, seq int, lon double, lat double")

# --- Fixed values: column names found in the source files, mapped by name ---

NAMES_M = {
    "ID.simulation": "sim_id",
    "plotcode": "plot",
    "ssp": "scenario",
    "Lon": "lon",
    "Lat": "lat",
    "time": "year",
    "BA": "value",
    "valeurs_clim": "grade",
}
NAMES_P = {
    "IDP": "plot",
    "Scenario": "scenario",
    "Year": "year",
    "speciesName": "species",
    "basalAreaSum": "value",
    "Nom_latin": "species_latin",
    "Code_climessence": "grade_code",
    "valeurs_climessence": "grade",
}
NAMES_SITE = {
    "IDP": "plot",
    "Lat": "lat",
    "Lon": "lon",
    "GRECO": "greco",
    "SER": "ser",
    "RUM_90cm": "rum_90cm",
    "Fertility_score": "fertility_score",
    "Alt": "alt",
    "QuadraticMeanDiameter": "mean_diameter",
    "DominantHeight": "top_height",
    "DominantAge": "top_age",
    "N_GB": "large_stems",
    "N_BM": "medium_stems",
    "N_PB": "small_stems",
    "N_Regrowth": "young_stems",
}

# --- End of fixed values ---


def canonical(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns by name; columns the source does not have are left out of the mapping."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def clean(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column, so that missing has one meaning."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: nan_to_null(name) for name in floats}) if floats else df


def with_empty(df: DataFrame, name: str, kind: str = "double") -> DataFrame:
    """Add a typed column of missing values."""
    return df.withColumn(name, F.lit(None).cast(kind))


def as_category(df: DataFrame, *names: str) -> DataFrame:
    """Treat columns as categories: text, with the sorted order as the level order."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})
