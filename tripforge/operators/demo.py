"""Recommendations from features alone, their smoke evaluation, and coverage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripforge.functions.scoring import ratio
from tripforge.operators.attraction import CONTEXT, rank_areas


def rank_from_origin(requests: DataFrame, popularity: DataFrame, scored: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """The areas that riders of an origin went to in a context, then all others: by count,
    visits, id. requests: the columns of `by` with origin_id, period, weekday_class;
    popularity: origin_id, period, weekday_class, area_id, n; scored: `area_attraction`."""
    rows = requests.select(*dict.fromkeys([*by, "origin_id", *CONTEXT])).join(scored.select(*CONTEXT, "area_id", "visits", "area_score"), CONTEXT)
    rows = rows.join(popularity.select("origin_id", *CONTEXT, "area_id", "n"), ["origin_id", *CONTEXT, "area_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("visits"), "area_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def recommend(requests: DataFrame, popularity: DataFrame, scored: DataFrame, top: int = 5) -> DataFrame:
    """request_id, model, fallback_used, rank, area_id, score. requests: request_id,
    origin_id, assignment (of `density.assign`), period, weekday_class. A request within a
    density area gets that origin's favourites, any other the best areas of its context."""
    known = F.coalesce(F.col("assignment") == "density", F.lit(False))
    own = rank_from_origin(requests.where(known), popularity, scored, ["request_id"], top)
    best = requests.where(~known).select("request_id", *CONTEXT).join(rank_areas(scored, CONTEXT, top), CONTEXT)
    tell = lambda df, name, used, score: df.select("request_id", F.lit(name).alias("model"), F.lit(used).alias("fallback_used"), "rank", "area_id", score.cast("double").alias("score"))
    return tell(own, "origin_period_popularity", False, F.col("n")).unionByName(tell(best, "area_attraction_fallback", True, F.col("area_score")))


def smoke_metrics(positions: DataFrame) -> DataFrame:
    """positions: model, actual (null where the destination is in no area), rank (of the
    actual area in the model's list, or null) -> shares and means by model; 0 where nothing
    could be evaluated."""
    hit = F.col("actual").isNotNull() & (F.col("rank") <= 5)
    sums = positions.groupBy("model").agg(F.count(F.lit(1)).alias("rows_in_scope"), F.count("actual").alias("evaluated"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
    return sums.select("model", "rows_in_scope", ratio(F.col("evaluated"), F.col("rows_in_scope")).alias("destination_coverage"), "evaluated", ratio(F.col("hits"), F.col("evaluated")).alias("hit5"), ratio(F.col("mrr"), F.col("evaluated")).alias("mrr5"))


def destination_coverage(trips: DataFrame, region: str = "Taipei") -> DataFrame:
    """One row: trips, those that end in the region, those of them with a density area,
    and their share. trips: dropoff_region, dropoff_assignment."""
    inside = F.col("dropoff_region") == region
    n = trips.agg(F.count(F.lit(1)).alias("trips"), F.count_if(inside).alias("in_region"), F.count_if(inside & (F.col("dropoff_assignment") == "density")).alias("verified"))
    return n.withColumn("destination_coverage", ratio(F.col("verified"), F.col("in_region")))


def fallbacks(trips: DataFrame) -> DataFrame:
    """side, region, n: ends of trips that no density area took. trips: pickup_region,
    pickup_assignment, dropoff_region, dropoff_assignment."""
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_region").alias("region"), F.col(f"{s}_assignment").alias("assignment")) for s in ("pickup", "dropoff")]))
    return trips.select(ends.alias("e")).select("e.*").where("assignment = 'fallback'").groupBy("side", "region").agg(F.count(F.lit(1)).alias("n"))


def evidence_points(areas: DataFrame, probes: DataFrame, period: str = "dinner", day: str = "weekday") -> DataFrame:
    """Two requests that show both ways of `recommend`: verified_area, the centre of the
    first area by id, and fallback_area, the first probe that no area takes (or else the
    first probe, marked so). areas: area_id, lat, lng; probes: seq, lat, lng, assignment."""
    dense = areas.orderBy("area_id").limit(1).select(F.lit("verified_area").alias("request_id"), "lat", "lng", F.lit("density").alias("assignment"))
    missed = F.col("assignment") != "fallback"
    probe = probes.orderBy(F.coalesce(missed, F.lit(True)), "seq").limit(1)
    named = F.when(F.coalesce(missed, F.lit(True)), "fallback_probe_not_found").otherwise("fallback")
    out = dense.unionByName(probe.select(F.lit("fallback_area").alias("request_id"), "lat", "lng", named.alias("assignment")))
    return out.withColumn("period", F.lit(period)).withColumn("weekday_class", F.lit(day))
