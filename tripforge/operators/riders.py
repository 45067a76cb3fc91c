"""Rider profiles, their areas, cohorts, and riders that are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripforge.functions.calendar import PERIODS
from tripforge.functions.scoring import personalization_level, ratio, rider_key
from tripforge.operators import neighbours
from tripforge.operators.quantiles import quantiles

NUMERIC = ["p25_km", "median_km", "p75_km", "p90_km", *[f"{p}_ratio" for p in PERIODS]]
NEIGHBOURS = 50
#: Blocks of which all pairs meet.
FEW_BLOCKS = 8


def rider_profiles(trips: DataFrame, salt: str | None = None) -> DataFrame:
    """One row per rider of the training trips: counts, exact quantiles, ratios. With a
    salt, riders are known by pseudonym only."""
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    known = F.col("origin_id").isNotNull() & F.col("area_id").isNotNull()
    out = trips.groupBy("rider_id").agg(
        F.count(F.lit(1)).alias("trip_count"), F.expr("percentile(distance_km, array(0.25D, 0.5D, 0.75D, 0.9D))").alias("q"), F.expr("percentile(travel_time_min, 0.5D)").alias("median_min"),
        *[share(F.col("period") == p).alias(f"{p}_ratio") for p in PERIODS], share(F.col("weekday_class") == "weekend").alias("weekend_ratio"),
        ratio(F.count_if(known & (F.col("origin_id") != F.col("area_id"))), F.count_if(known)).alias("cross_area_ratio"), F.avg("fare_midpoint").alias("fare_mean"),
    )
    q = [F.col("q")[i].alias(n) for i, n in enumerate(NUMERIC[:4])]
    key = F.col("rider_id") if salt is None else rider_key(F.col("rider_id"), salt).alias("rider_key")
    return out.select(key, "trip_count", personalization_level(F.col("trip_count")).alias("level"), *q, "median_min", *NUMERIC[4:], "weekend_ratio", "cross_area_ratio", "fare_mean")


def rider_areas(trips: DataFrame) -> DataFrame:
    """Visits of each rider to each area by period, and their share of all trips."""
    total = trips.groupBy("rider_id").agg(F.count(F.lit(1)).alias("trip_count"))
    visits = trips.where("area_id is not null").groupBy("rider_id", "area_id", "period").agg(F.count(F.lit(1)).alias("visits"))
    return visits.join(total, "rider_id").select("rider_id", "area_id", "period", "visits", ratio(F.col("visits"), F.col("trip_count")).alias("visit_ratio"))


def cohort_quantiles(trips: DataFrame) -> DataFrame:
    """Distance quantiles of all trips that have a distance, by the riders' level."""
    level = trips.groupBy("rider_id").agg(personalization_level(F.count(F.lit(1))).alias("level"))
    q = quantiles(trips.join(level, "rider_id").select("level", "distance_km"), ["level"], "distance_km", [0.25, 0.5, 0.75, 0.9])
    return q.select("level", F.col("n").alias("trips"), *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))])


def tier_counts(trips: DataFrame) -> DataFrame:
    riders = trips.groupBy("rider_id").agg(F.count(F.lit(1)).alias("n"))
    return riders.groupBy(personalization_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("riders"), F.sum("n").alias("trips"))


def b_scale(rider_area: DataFrame, profiles: DataFrame) -> DataFrame:
    """5th and 95th percentile of log(1 + visits) over riders that aren't cold."""
    rows = rider_area.join(profiles.where("level <> 'cold'").select("rider_id"), "rider_id", "left_semi")
    q = quantiles(rows.select(F.ln(1.0 + F.col("visits")).alias("v")), [], "v", [0.05, 0.95])
    return q.select(F.col("q")[0].alias("p5"), F.col("q")[1].alias("p95"))


def rider_vectors(profiles: DataFrame, rider_area: DataFrame, level: str = "full") -> DataFrame:
    """(rider_id, dim, w): standardised numbers (weight 0.6) and log area visits (0.4),
    each part of unit length, together of unit length."""
    chosen = profiles.where(F.col("level") == level)
    stats = chosen.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMERIC], *[F.stddev_pop(c).alias(f"s_{c}") for c in NUMERIC])
    scaled = chosen.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    numeric = scaled.select("rider_id", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), z(c).alias("w")) for c in NUMERIC])).alias("d")).select("rider_id", "d.*", F.lit(0.6).alias("part"))
    areas = rider_area.join(chosen.select("rider_id"), "rider_id", "left_semi").groupBy("rider_id", "area_id").agg(F.sum("visits").alias("n"))
    areas = areas.select("rider_id", F.concat(F.lit("area-"), F.col("area_id").cast("string")).alias("dim"), F.log1p(F.col("n").cast("double")).alias("w"), F.lit(0.4).alias("part"))
    rows = numeric.unionByName(areas)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("rider_id", "part")))
    rows = rows.withColumn("w", F.coalesce(F.try_divide(F.col("w"), length), F.lit(0.0)) * F.col("part"))
    whole = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("rider_id")))
    return rows.select("rider_id", "dim", F.coalesce(F.try_divide(F.col("w"), whole), F.lit(0.0)).alias("w"))


def cosine_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, key: str = "rider_id", block: int = 512) -> DataFrame:
    """vectors: key, v (array of unit length) -> the k most similar others of each, by
    similarity, then key; none at or below 0. Few blocks of rows meet pairwise, each pair in
    a task; of more, pairs that can't matter are left out first."""
    blocks = max(1, -(-vectors.count() // block))
    if blocks > FEW_BLOCKS:
        return neighbours.nearest(vectors, k, key, block)
    at = F.pmod(F.xxhash64(key), F.lit(blocks))
    rows = vectors.select(F.col(key).alias("key"), F.col("v").cast("array<double>").alias("v"), at.alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("key", "v", F.lit(0.0).alias("floor"), F.col("b").alias("i"), every.alias("j"))
    right = rows.select(F.col("key").alias("r_key"), F.col("v").alias("r_v"), every.alias("i"), F.col("b").alias("j"))

    best = lambda a, b: neighbours.best_of(a, b, k)
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "key long, neighbour long, similarity double")
    w = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("key").alias(key), "neighbour", "similarity", "rank")


def dense(vectors: DataFrame, key: str = "rider_id") -> DataFrame:
    """Long-form vectors as arrays over the sorted dimensions (their number is small)."""
    dims = [r.dim for r in vectors.select("dim").distinct().orderBy("dim").collect()]
    at = F.map_from_entries(F.collect_list(F.struct("dim", "w")))
    rows = vectors.groupBy(key).agg(at.alias("m"))
    return rows.select(key, F.array(*[F.coalesce(F.col("m")[d], F.lit(0.0)) for d in dims]).alias("v"))
