"""Fixed tables: the symbol catalogue, aliases, defaults and road types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Object types by category as (id, symbol, label).
CATALOG = {
    "point": [
        ("boulder", "206", "Sten"), ("boulder_large", "204", "Stor sten"), ("knoll", "109", "Punkthöjd"),
        ("pit", "202", "Grop"), ("tower", "524", "Torn"), ("well", "311", "Brunn"), ("rootstock", "115", "Rotvälta"),
    ],
    "line": [
        ("paved_road", "502", "Asfalterad väg"), ("road", "503", "Väg"), ("gravel_road", "504", "Grusväg"),
        ("wide_path", "505", "Bred stig"), ("path", "506", "Stig"), ("faint_path", "507", "Svag stig"),
        ("ditch", "307", "Dike"), ("stream", "304", "Mindre vattendrag"), ("fence", "516", "Staket"),
        ("wall", "513.1", "Mur"), ("cliff", "201", "Brant"),
    ],
    "area": [
        ("building", "521", "Byggnad"), ("dense", "408", "Tät skog"), ("very_dense", "410", "Mycket tät skog"),
        ("open_land", "401", "Öppen mark"), ("field", "402", "Öppen mark med spridda träd"), ("clearcut", "404", "Hygge"),
        ("marsh", "310", "Myr"), ("hard_marsh", "309", "Fast mark i myr"), ("lake", "301", "Sjö"), ("forbidden", "520", "Förbjudet område"),
    ],
}
DEFAULTS = {"point": "boulder", "line": "path", "area": "dense"}
ALIASES = {"stone": "boulder", "large_boulder": "boulder_large", "point_height": "knoll", "dense_forest": "dense", "very_dense_forest": "very_dense", "open": "open_land"}
#: Symbol to (type, label).
ROAD_TYPES = {
    "502": ("wide_road", "Bred väg"), "503": ("road", "Väg"), "504": ("vehicle_track", "Fordonsstig"),
    "505": ("wide_path", "Bred stig"), "506": ("path", "Stig"), "507": ("faint_path", "Otydlig stig"),
}
UNVERIFIED, APPROVED, REJECTED, EDITED = "automatic-unverified", "locally-approved", "locally-rejected", "locally-edited"
CONFIDENCE = {"high": "hög", "medium": "medel", "low": "låg"}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a fixed table, or null."""
    return F.try_element_at(literal_map(pairs), key)


def truthy(text: Column) -> Column:
    """Null for the empty string, which counts as missing."""
    return F.nullif(text, F.lit(""))


def catalog(spark: SparkSession) -> DataFrame:
    """category, object_type, symbol, label: 28 rows, of a fixed size and so broadcast by users of it."""
    rows = [(c, *r) for c, group in CATALOG.items() for r in group]
    return spark.createDataFrame(rows, "category string, object_type string, catalog_symbol string, label string")


def road_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ROAD_TYPES.items()], "isom_symbol string, road_type string, label string")


def default_type(category: Column) -> Column:
    return lookup(DEFAULTS, category)


def resolved_alias(object_type: Column) -> Column:
    return F.coalesce(lookup(ALIASES, object_type), object_type)
