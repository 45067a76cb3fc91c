"""Distances and regions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0088
ROAD_FACTOR = 1.30
#: Name, latitude from, to, whether the end belongs, longitude likewise.
REGIONS = (
    ("Taipei", 24.7, 25.4, True, 121.2, 122.0, True),
    ("Taichung", 23.8, 24.7, False, 120.2, 121.4, False),
    ("Kaohsiung", 22.4, 23.8, False, 120.0, 121.2, False),
)
OTHER_REGION = "Other/Unknown"


def haversine_km(lat_a, lng_a, lat_b, lng_b) -> Column:
    a, b = F.radians(lat_a), F.radians(lat_b)
    half_lat, half_lng = (b - a) / 2.0, (F.radians(lng_b) - F.radians(lng_a)) / 2.0
    x = F.pow(F.sin(half_lat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lng), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), x)))


def road_distance_km(lat_a, lng_a, lat_b, lng_b) -> Column:
    return haversine_km(lat_a, lng_a, lat_b, lng_b) * ROAD_FACTOR


def region_bucket(lat: Column, lng: Column) -> Column:
    out = F.lit(OTHER_REGION)
    for name, lat0, lat1, lat_in, lng0, lng1, lng_in in reversed(REGIONS):
        inside = (lat >= lat0) & ((lat <= lat1) if lat_in else (lat < lat1)) & (lng >= lng0) & ((lng <= lng1) if lng_in else (lng < lng1))
        out = F.when(inside, name).otherwise(out)
    return out


def route_fallback(lat_a, lng_a, lat_b, lng_b) -> tuple[Column, Column]:
    """(km, minutes) where no route is known."""
    km = road_distance_km(lat_a, lng_a, lat_b, lng_b)
    return F.bround(km, 2), F.greatest(F.lit(5), F.bround(km / 0.32, 0).cast("int"))
