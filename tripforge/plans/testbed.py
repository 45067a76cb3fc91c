"""A trip view over the driver's tables, in integer arithmetic, so that Spark and an SQL
engine derive identical trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripforge.functions.calendar import period_of_hour
from tripforge.operators.clean import flag_duplicates

CELLS = 6
STEP = 20


def centroid(cell_axis):
    """Degrees of a cell's centre along an axis, from thousandths."""
    return (cell_axis * F.lit(STEP) + F.lit(STEP // 2)) / F.lit(1000.0)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with its order; trip_id repeats. `duplicate` flags all but
    the first of an id, by l_shipdate, l_partkey, l_suppkey, price, quantity."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    line = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    order = read("orders", "o_orderkey", "o_custkey")
    # an id is of one order as long as numbers of lines are below 8: no shuffle by id is needed then
    odd = line.where("l_linenumber IS NULL OR l_linenumber NOT BETWEEN 0 AND 7").limit(1).count()
    t = line.join(order, line.l_orderkey == order.o_orderkey).withColumn("n", F.col("l_linenumber").cast("long"))
    x = F.col("l_partkey") * 37 + F.col("l_suppkey") * 101 + F.col("n")
    minutes = (F.col("l_orderkey") * 1009 + F.col("l_partkey") * 7919 + F.col("n") * 31) % 128160
    day = F.floor(F.col("start_min") / 1440)
    t = t.select(
        (F.col("l_orderkey") * 8 + F.col("n")).alias("trip_id"), (F.col("o_custkey") * 7 + F.col("n")).alias("rider_id"), minutes.alias("start_min"),
        F.col("l_quantity").cast("long").alias("travel_time_min"), F.when(x % 97 == 0, 0).otherwise(x % 12000).alias("travel_distance_m"),
        F.when(F.col("l_partkey") % 53 == 0, 5).otherwise(1).cast("long").alias("jitter"),
        ((F.col("l_suppkey") * 7 + F.col("n") * 13) % 120).alias("p_lat"), ((F.col("l_suppkey") * 11 + F.col("n") * 17) % 120).alias("p_lng"),
        ((F.col("l_partkey") * 3 + F.col("o_custkey")) % 120).alias("d_lat"), ((F.col("l_partkey") * 5 + F.col("o_custkey") * 2) % 120).alias("d_lng"),
        (100 * (1 + F.col("l_partkey") % 5)).alias("fare_lo"), (100 * (2 + F.col("l_partkey") % 5)).alias("fare_hi"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_orderkey",
    )
    order_by = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    t = flag_duplicates(t, "trip_id", order_by, within=() if odd else ("l_orderkey",))
    t = t.withColumn("day", day).withColumn("hour", F.floor(F.col("start_min") / 60) % 24)
    area = lambda lat, lng: (F.floor(F.col(lat) / STEP) * CELLS + F.floor(F.col(lng) / STEP)).cast("long")
    return t.select(
        "trip_id", "rider_id", "start_min", "travel_time_min", "travel_distance_m", "jitter", "p_lat", "p_lng", "d_lat", "d_lng", "duplicate", "day", "hour",
        (F.col("fare_lo") + 1).cast("double").alias("fare_lower_exclusive"), ((F.col("fare_lo") + 1 + F.col("fare_hi")) / F.lit(2.0)).alias("fare_midpoint"),
        period_of_hour(F.col("hour")).alias("period"), F.when((F.col("day") + 6) % 7 >= 5, "weekend").otherwise("weekday").alias("weekday_class"),
        F.when(F.col("day") < 43, "train").when(F.col("day") < 59, "validation").otherwise("test").alias("split"),
        (F.col("travel_distance_m") / F.lit(1000.0)).alias("distance_km"), area("p_lat", "p_lng").alias("origin_id"), area("d_lat", "d_lng").alias("area_id"),
        F.when(F.col("p_lat") < 60, "north").otherwise("south").alias("pickup_region"),
    )


def is_eligible() -> Column:
    """First occurrences without soft faults; speeds compared in integers."""
    too_fast = F.col("travel_distance_m") * 60 > F.col("travel_time_min") * 120_000
    too_slow = F.col("travel_distance_m") * 60 < F.col("travel_time_min") * 1000
    return ~F.col("duplicate") & (F.col("travel_distance_m") > 0) & (F.col("jitter") <= 2) & ~too_fast & ~too_slow


def eligible(t: DataFrame) -> DataFrame:
    return t.where(is_eligible())


def areas(spark: SparkSession) -> DataFrame:
    """The grid's 36 areas with their centres."""
    a = spark.range(CELLS * CELLS).select(F.col("id").alias("area_id"))
    return a.select("area_id", centroid(F.floor(F.col("area_id") / CELLS)).alias("lat"), centroid(F.col("area_id") % CELLS).alias("lng"))


#: The same for DuckDB: CTEs raw, trips, ok (eligible) and areas.
SQL = """
WITH raw AS (
  SELECT *, l_linenumber::BIGINT AS n, l_partkey * 37 + l_suppkey * 101 + l_linenumber AS x,
         (l_orderkey * 1009 + l_partkey * 7919 + l_linenumber * 31) % 128160 AS start_min
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
flat AS (
  SELECT l_orderkey * 8 + n AS trip_id, o_custkey * 7 + n AS rider_id, start_min, l_quantity::BIGINT AS travel_time_min,
         CASE WHEN x % 97 = 0 THEN 0 ELSE x % 12000 END AS travel_distance_m, CASE WHEN l_partkey % 53 = 0 THEN 5 ELSE 1 END AS jitter,
         (l_suppkey * 7 + n * 13) % 120 AS p_lat, (l_suppkey * 11 + n * 17) % 120 AS p_lng, (l_partkey * 3 + o_custkey) % 120 AS d_lat, (l_partkey * 5 + o_custkey * 2) % 120 AS d_lng,
         100 * (1 + l_partkey % 5) AS fare_lo, 100 * (2 + l_partkey % 5) AS fare_hi, start_min // 1440 AS day, (start_min // 60) % 24 AS hour,
         row_number() OVER (PARTITION BY l_orderkey * 8 + n ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) > 1 AS duplicate
  FROM raw),
trips AS (
  SELECT trip_id, rider_id, start_min, travel_time_min, travel_distance_m, jitter, p_lat, p_lng, d_lat, d_lng, duplicate, day, hour,
         (fare_lo + 1)::DOUBLE AS fare_lower_exclusive, (fare_lo + 1 + fare_hi)::DOUBLE / 2 AS fare_midpoint,
         CASE WHEN hour BETWEEN 5 AND 10 THEN 'morning' WHEN hour BETWEEN 11 AND 13 THEN 'lunch' WHEN hour BETWEEN 14 AND 16 THEN 'afternoon' WHEN hour BETWEEN 17 AND 20 THEN 'dinner' ELSE 'night' END AS period,
         CASE WHEN (day + 6) % 7 >= 5 THEN 'weekend' ELSE 'weekday' END AS weekday_class,
         CASE WHEN day < 43 THEN 'train' WHEN day < 59 THEN 'validation' ELSE 'test' END AS split,
         travel_distance_m::DOUBLE / 1000 AS distance_km, (p_lat // 20) * 6 + p_lng // 20 AS origin_id, (d_lat // 20) * 6 + d_lng // 20 AS area_id,
         CASE WHEN p_lat < 60 THEN 'north' ELSE 'south' END AS pickup_region
  FROM flat),
ok AS (SELECT * FROM trips WHERE NOT duplicate AND travel_distance_m > 0 AND jitter <= 2 AND travel_distance_m * 60 <= travel_time_min * 120000 AND travel_distance_m * 60 >= travel_time_min * 1000),
areas AS (SELECT i AS area_id, ((i // 6) * 20 + 10)::DOUBLE / 1000 AS lat, ((i % 6) * 20 + 10)::DOUBLE / 1000 AS lng FROM range(36) t(i))
"""
