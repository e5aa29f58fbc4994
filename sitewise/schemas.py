"""The tables' schemas."""

from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

#: One element of a POI response.
ELEMENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("center", _POINT),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: A whole recorded response.
RESPONSE = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT))])

FACILITIES = "osm_id bigint, osm_type string, name string, amenity string, healthcare string, lon double, lat double"
RING = "array<struct<x: double, y: double>>"
HEXAGONS = f"population double, ring {RING}"
BOXED_HEXAGONS = f"{HEXAGONS}, min_x double, max_x double, min_y double, max_y double"
ESTIMATES = "cell_id string, wealth_score int, area_character string, confidence double"
CACHE = "key string, wealth_score int, area_character string, confidence double"
RECOMMENDED = "cell_id string, center_lon double, center_lat double, facility_type string, best_score double"
PRICES = "cell_id string, price_per_m2 double"
VALIDATION = "scenario string, before double, after double, improvement double"
