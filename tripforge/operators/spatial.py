"""Joins of points and areas by distance, through cells instead of all pairs.

The sphere is cut into rows of latitude, and each row into as many cells as keep their
width near the row's height. An area is put into every cell that its circle's bounding box
touches (an exact bound on the sphere, also at the poles and across the date line), a point
into its own cell; the two meet by an equi-join on the cell, and the exact distance decides.
Points and areas may both be many; where areas are few, Spark broadcasts them by itself.
Cells that hold many points are split by adaptive execution.

The nearest area is looked for in circles that grow: one found within the radius that was
searched is the nearest, and only points without any go on to a wider circle.

Latitudes are in degrees within -90 and 90; longitudes may be beyond 180. Points without a
place, or null in a coordinate, are near nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tripforge.functions.geo import EARTH_RADIUS_KM, haversine_km
from tripforge.sources.scratch import stored

HALF_AROUND_KM = math.pi * EARTH_RADIUS_KM
#: The smallest cell in degrees, and what keeps rounding from cutting a circle off.
SMALLEST, SLACK = 1e-4, 1e-7
#: By how much a circle widens in which nothing was found.
WIDER = 4.0


def _row(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(step))


def _cells(row: Column, step: float) -> Column:
    """How many cells a row has: fewer towards the poles."""
    middle = F.radians((row + 0.5) * F.lit(step) - 90.0)
    return F.greatest(F.floor(F.cos(middle) * (360.0 / step)), F.lit(1))


def _column(lng: Column, n: Column) -> Column:
    """Not yet taken around the sphere."""
    return F.floor((lng + 180.0) * n / 360.0)


def within(points: DataFrame, areas: DataFrame, km: float) -> DataFrame:
    """Pairs of points (with lat, lng) and areas (with a_lat, a_lng) at most km apart as the
    crow flies, and km: their distance. Columns of the two must have different names."""
    pairs = held(points, km).join(spread(areas, km), ["_row", "_cell"]).drop("_row", "_cell")
    return pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("a_lat"), F.col("a_lng"))).where(F.col("km") <= km)


def _step(km: float) -> tuple[float, float]:
    """The circle as an angle, and the height of a row."""
    arc = min(math.pi, km / EARTH_RADIUS_KM)
    return arc, min(180.0, max(SMALLEST, math.degrees(arc)))


def spread(areas: DataFrame, km: float) -> DataFrame:
    """Areas with each cell (_row, _cell) that points within km of them can be in."""
    arc, step = _step(km)
    reach = math.degrees(arc) + SLACK
    lat, lng = F.col("a_lat"), F.col("a_lng")
    rows = F.explode(F.sequence(_row(F.greatest(lat - reach, F.lit(-90.0)), step), _row(F.least(lat + reach, F.lit(90.0)), step)))
    wanted = areas.where("a_lat IS NOT NULL AND a_lng IS NOT NULL").withColumn("_row", rows)
    # the circle's widest longitude; a circle around a pole has all of them
    polar = F.abs(lat) + reach >= 90.0
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(arc, math.pi / 2))) / F.cos(F.radians(lat))))) + SLACK
    n = _cells(F.col("_row"), step)
    first, last = _column(lng - wide, n), _column(lng + wide, n)
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    some = F.when(polar | (last - first + 1 >= n), every).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, n)))
    return wanted.withColumn("_cell", F.explode(some))


def held(points: DataFrame, km: float) -> DataFrame:
    """Points that have a place with their cell (_row, _cell)."""
    step = _step(km)[1]
    row = _row(F.col("lat"), step)
    placed = points.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("_row", row)
    n = _cells(F.col("_row"), step)
    return placed.withColumn("_cell", F.pmod(_column(F.col("lng"), n), n))


def nearest(points: DataFrame, areas: DataFrame, key: str, start_km: float | None = None) -> DataFrame:
    """points: key, lat, lng; areas: area_id, lat, lng -> key, area_id and km of the nearest
    area; distances that agree to nine digits are ties, which the smaller id wins. A row for
    each key that has a place, if there is an area at all."""
    there = areas.where("lat IS NOT NULL AND lng IS NOT NULL").select("area_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    box = there.agg(F.count(F.lit(1)).alias("n"), F.max("a_lat").alias("n_"), F.min("a_lat").alias("s_"), F.max("a_lng").alias("e_"), F.min("a_lng").alias("w_")).first()
    todo = points.select(F.col(key), "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL")
    if not box.n:
        return todo.where(F.lit(False)).select(key, F.lit(None).cast(areas.schema["area_id"].dataType).alias("area_id"), F.lit(None).cast("double").alias("km"))
    # at first about a circle for each area, if they lie evenly
    radius = start_km or max(0.05, 111.2 * max(box.n_ - box.s_, box.e_ - box.w_) / math.sqrt(box.n))
    todo, out = stored(todo, "points"), None
    while True:
        near = within(todo, there, radius * (1 + 1e-9) + 1e-8)
        near = near.groupBy(key).agg(F.min(F.struct(F.round("km", 9).alias("km"), "area_id")).alias("x")).select(key, "x.area_id", "x.km")
        near = stored(near.where(F.col("km") <= radius), "nearest")
        out = near if out is None else out.unionByName(near)
        todo = stored(todo.join(near, key, "left_anti"), "points")
        if radius >= HALF_AROUND_KM or todo.isEmpty():
            return out
        radius = min(HALF_AROUND_KM, radius * WIDER)
