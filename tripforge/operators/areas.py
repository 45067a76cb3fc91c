"""Coordinate pools, stratified samples, area summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripforge.functions.geo import haversine_km, region_bucket
from tripforge.operators.quantiles import quantiles
from tripforge.sources.scratch import stored


def coordinate_pool(trips: DataFrame) -> DataFrame:
    """Pickups and dropoffs as points: key, side, lat, lng, region."""
    point = lambda side: F.struct(F.lit(side).alias("side"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lng").alias("lng"))
    return trips.select("trip_id", "region", F.explode(F.array(point("pickup"), point("dropoff"))).alias("p")).select("trip_id", "region", "p.*")


def endpoint_samples(trips: DataFrame, most: int, order: str = "row_number") -> DataFrame:
    """The pickups and dropoffs of the first `most` trips: side, lat, lng, region of the
    point. The limit is the sample's size, taken by Spark as a top-k of each task."""
    first = trips.orderBy(order).limit(most)
    point = lambda side: F.struct(F.lit(side).alias("side"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lng").alias("lng"))
    rows = first.select(F.explode(F.array(point("pickup"), point("dropoff"))).alias("p")).select("p.*")
    return rows.withColumn("region", region_bucket(F.col("lat"), F.col("lng")))


def stratified_sample(points: DataFrame, size: int, key: str, stratum: str = "region") -> DataFrame:
    """Points by hash order within their stratum, taken evenly; a smaller sample is the
    beginning of a larger one. A point of rank r among n is taken only if (r - 1) / n is at
    most size / total, so counts by hash range tell where the order can be cut: the window
    sees about `size` rows and the last ranges, not all rows of a stratum in one task."""
    rows = stored(points.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)), "hashed")
    rows = rows.withColumn("_range", F.coalesce(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(-1)))
    ranges = rows.groupBy(F.col(stratum).alias("_s"), "_range").agg(F.count(F.lit(1)).alias("_k"))
    total = ranges.agg(F.sum("_k").alias("_total"))
    w = Window.partitionBy("_s")  # at most 65,537 rows a stratum
    ranges = ranges.withColumn("_n", F.sum("_k").over(w)).withColumn("_before", F.sum("_k").over(w.orderBy("_range")) - F.col("_k"))
    ranges = ranges.crossJoin(F.broadcast(total))  # one row
    needed = ranges.where(F.col("_before") <= F.ceil(F.lit(float(size)) * F.col("_n") / F.col("_total")) + 1)
    last = needed.groupBy("_s").agg(F.max("_range").alias("_last"), F.first("_n").alias("_n"))
    kept = rows.join(last, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_range") <= F.col("_last")))
    kept = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    return kept.orderBy((F.col("_rank") - 1) / F.col("_n"), stratum, "_h", key).limit(size).select(*points.columns)


def area_summary(points: DataFrame) -> DataFrame:
    """points: area_id, lat, lng, region -> members, mean centre, region of most members
    (then by name) with its share, 90th percentile of the distance to the centre."""
    centre = points.groupBy("area_id").agg(F.count(F.lit(1)).alias("members"), F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))
    region = points.groupBy("area_id", "region").agg(F.count(F.lit(1)).alias("n"))
    region = region.groupBy("area_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "region")).alias("r"))
    away = points.join(centre, "area_id").select("area_id", haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")).alias("km"))
    radius = quantiles(away, ["area_id"], "km", [0.9]).select("area_id", F.col("q")[0].alias("radius_p90_km"))
    out = centre.join(region, "area_id").join(radius, "area_id")
    return out.select("area_id", "members", "c_lat", "c_lng", F.col("r.region").alias("region"), (-F.col("r.n") / F.col("members")).alias("region_share"), "radius_p90_km")
