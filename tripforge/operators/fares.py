"""Fare ranges by distance, period and region, and the ladder that looks them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripforge.functions.scoring import distance_bin
from tripforge.operators.quantiles import quantiles

ALL_PERIODS, ALL_REGIONS = "all_periods", "all_regions"
LADDER = ("distance_period_region", "distance_period_all_regions", "distance_all_periods_region", "distance_only")


def fare_cube(trips: DataFrame, least: int = 30) -> DataFrame:
    """trips: distance_km, period, pickup_region, fare_midpoint of training trips. Four
    grouping sets, each with the distance bin, as four rows a trip; groups of fewer than
    `least` fares are left out."""
    rows = trips.select(distance_bin(F.col("distance_km")).alias("distance_bin"), "period", F.col("pickup_region").alias("region"), "fare_midpoint")
    group = lambda period, region: F.struct("distance_bin", period.alias("period"), region.alias("region"))
    period, region = (F.col("period"), F.lit(ALL_PERIODS)), (F.col("region"), F.lit(ALL_REGIONS))
    long = rows.select("fare_midpoint", F.explode(F.array(*[group(p, r) for p in period for r in region])).alias("g")).select("g.*", "fare_midpoint")
    cube = quantiles(long, ["distance_bin", "period", "region"], "fare_midpoint", [0.25, 0.75]).where(F.col("n") >= least)
    return cube.select("distance_bin", "period", "region", F.col("n").alias("sample_count"), F.bround(F.col("q")[0], 2).alias("fare_p25"), F.bround(F.col("q")[1], 2).alias("fare_p75"))


def fare_ladder(requests: DataFrame, cube: DataFrame) -> DataFrame:
    """requests: request_id, distance_km, period, region -> the first rung that has a
    fare, null fares where none has."""
    rung = lambda i, p, r: F.struct(F.lit(i).alias("rung"), F.lit(LADDER[i]).alias("source"), p.alias("period"), r.alias("region"))
    period, region = F.col("period"), F.col("region")
    rungs = F.array(rung(0, period, region), rung(1, period, F.lit(ALL_REGIONS)), rung(2, F.lit(ALL_PERIODS), region), rung(3, F.lit(ALL_PERIODS), F.lit(ALL_REGIONS)))
    keys = requests.select("request_id", distance_bin(F.col("distance_km")).alias("distance_bin"), F.explode(rungs).alias("k")).select("request_id", "distance_bin", "k.*")
    found = keys.join(cube, ["distance_bin", "period", "region"], "left")
    hit = F.when(F.col("sample_count").isNotNull(), F.struct("rung", "source", "fare_p25", "fare_p75", "sample_count"))
    best = found.groupBy("request_id", "distance_bin").agg(F.min(hit).alias("best"))
    return best.select("request_id", "distance_bin", "best.source", "best.fare_p25", "best.fare_p75", "best.sample_count")
