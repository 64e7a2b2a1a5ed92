"""Distances on a sphere, radius search and regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the Earth's radius in metres.
RADIUS = 6371000.0


def metres(lat: Column, lng: Column, to_lat: float, to_lng: float) -> Column:
    """Haversine distance; null where a coordinate is missing, 0 for equal points."""
    a = F.pow(F.sin((F.radians(F.lit(to_lat)) - F.radians(lat)) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.pow(F.sin((F.radians(F.lit(to_lng)) - F.radians(lng)) / 2), 2)
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within(df: DataFrame, lat: float, lng: float, radius_m: float) -> DataFrame:
    """Rows within a radius, with distance_m. The box comes first: plain comparisons that reach the file statistics."""
    north = math.degrees(radius_m / RADIUS) * 1.001
    east = north / max(0.01, math.cos(math.radians(lat)))
    box = F.col("lat").between(lat - north, lat + north) & F.col("lng").between(lng - east, lng + east)
    return df.where(box).withColumn("distance_m", metres(F.col("lat"), F.col("lng"), lat, lng)).where(F.col("distance_m") <= radius_m)


def js_round(x: Column, digits: int = 0) -> Column:
    """Round halves up, towards plus infinity."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def geohash(lat: Column, lng: Column, precision: int = 8) -> Column:
    """Geohash: the bits of longitude and latitude by turns, five to a character, by integer arithmetic in SQL."""
    bits = 5 * precision
    n_lng, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lng + 180) / 360 * 2**n_lng), F.lit(2**n_lng - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * 2**n_lat), F.lit(2**n_lat - 1)).cast("bigint")
    out = []
    for c in range(precision):
        value = F.lit(0)
        for k in range(5):
            at = c * 5 + k
            source, place = (x, n_lng - 1 - at // 2) if at % 2 == 0 else (y, n_lat - 1 - at // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1).cast("bigint"))
        out.append(F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), value.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.concat(*out))
