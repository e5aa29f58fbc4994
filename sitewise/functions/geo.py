"""Distances, travel times, the Mercator projection and polygon areas as column expressions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions import let

# Metres in a degree of latitude (grid steps), the earth's radius
# for distances, the radius of the spherical Mercator projection, km/h in town.
METERS_PER_DEGREE = 111_320.0
EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
SPEED_KMH = 25.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def minutes(distance_m: Column) -> Column:
    """Minutes on the way at the town speed."""
    return distance_m / 1000.0 / SPEED_KMH * 60.0


def mercator_x(lon: Column) -> Column:
    return MERCATOR_M * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return MERCATOR_M * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def longitude(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - 1.5707963267948966)


def to_metric(ring: Column) -> Column:
    """A ring of degrees (x: longitude, y: latitude) in projected metres."""
    return F.transform(ring, lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y")))


def to_geographic(ring: Column) -> Column:
    """A ring of projected metres in degrees."""
    return F.transform(ring, lambda p: F.struct(longitude(p["x"]).alias("x"), latitude(p["y"]).alias("y")))


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.greatest(F.size(ring), F.lit(1)))


def ring_area(ring: Column) -> Column:
    """Area of a ring, closed or not, of parts hung together too; of fewer than three corners 0."""

    def shoelace(r: Column) -> Column:
        # Around the first corner, so that large coordinates don't cancel.
        def crossed(p: Column, i: Column) -> Column:
            first = F.get(r, 0)
            return let(_next(r, i), lambda q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"]))

        return F.abs(F.aggregate(F.transform(r, crossed), F.lit(0.0), lambda a, c: a + c)) / 2

    return let(ring, lambda r: F.when(F.size(r) < 3, F.lit(0.0)).otherwise(shoelace(r)))


@F.pandas_udf(T.BinaryType())
def rectangle_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """An upright rectangle as well-known binary: a little-endian polygon of one closed ring."""
    head = struct.pack("<BIII", 1, 3, 1, 5)
    corners = np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1).astype("<f8")
    return pd.Series([head + row.tobytes() for row in corners])


def square(x: Column, y: Column, half: float) -> Column:
    """An upright square ring around a centre."""
    corners = ((-half, -half), (half, -half), (half, half), (-half, half))
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])
