"""Batch forms of the online services: areas, shortlists, restaurants, estimates, events.

A request is a row; all requests are ranked at once. A single request costs a Spark job,
seconds rather than milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripforge.functions.geo import ROAD_FACTOR, route_fallback
from tripforge.functions.scoring import area_blend, contextual_fit, event_id, poi_quality, proximity_fit, restaurant_score
from tripforge.operators import spatial

AREA_TOP, RESTAURANT_TOP, PER_AREA, SHORTLIST, AT_LEAST = 10, 5, 2, 20, 5


def nearest_area(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """points: key, lat, lng -> the nearest area, ties by id, with its distance; points
    without a place have none. Neither side has a limit."""
    return spatial.nearest(points, areas, key)


def in_budget(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """requests: with lat, lng, budget_km -> each with the areas in its budget, and distance
    on the road. Areas are found through cells as wide as the largest budget."""
    most = requests.agg(F.max("budget_km")).first()[0] or 0.0
    there = areas.select("area_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    near = spatial.within(requests, there, most / ROAD_FACTOR * (1 + 1e-9))
    return near.withColumn("distance", F.col("km") * ROAD_FACTOR).where("distance <= budget_km").drop("km", "a_lat", "a_lng")


def rank_areas(requests: DataFrame, areas: DataFrame, stats: DataFrame, weights: tuple[float, float] = (0.30, 0.70), proximity: float = 0.20, top: int = AREA_TOP) -> DataFrame:
    """requests: request_id, lat, lng, period, weekday_class, budget_km; stats: area_id,
    period, weekday_class, area_score. Areas beyond the budget are out. An optional
    c_score column of stats (by request) joins the base score."""
    rows = in_budget(requests, areas).join(stats, ["area_id", "period", "weekday_class"])
    c = F.col("c_score") if "c_score" in rows.columns else F.lit(None).cast("double")
    base = F.when(c.isNull(), F.col("area_score")).otherwise(weights[0] * F.col("area_score") + weights[1] * c)
    near = proximity_fit(F.col("distance"), F.col("budget_km"))
    rows = rows.withColumn("base_score", F.round(base, 6)).withColumn("proximity", near).withColumn("score", F.round(area_blend(base, near, proximity), 6))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "area_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("request_id", "rank", "area_id", F.round("distance", 4).alias("distance_km"), "base_score", "proximity", "score")


def area_records(ranked: DataFrame, areas: DataFrame, mobility: str = "personal_mobility") -> DataFrame:
    """request_id, rank, area: a record of each ranked area as services return it, with its
    centre and what its score is made of. ranked: request_id, rank, area_id, distance_km,
    score, and any of area_attraction, personal_mobility, base_score, proximity."""
    have = lambda c: F.col(c) if c in ranked.columns else F.lit(None).cast("double")
    of = areas.select("area_id", F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("centroid"), F.col("radius_p90_km").alias("radius_km"))
    parts = F.struct(have("area_attraction").alias("area_attraction"), have(mobility).alias("personal_mobility"), have("base_score").alias("base_model_score"), have("proximity").alias("proximity_fit"))
    return ranked.join(of, "area_id").select("request_id", "rank", F.struct("area_id", "centroid", "radius_km", "distance_km", "score", parts.alias("score_breakdown")).alias("area"))


def best_source(places: DataFrame) -> DataFrame:
    """Open places (or of unknown status), each with its best source area, first seen."""
    w = Window.partitionBy("request_id", "place_id").orderBy(F.desc("source_area_score"), "seq")
    rows = places.where(F.coalesce(F.col("open_status"), F.lit("")) != "closed")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_fixture(places: DataFrame, fixture: DataFrame, least: int = AT_LEAST) -> DataFrame:
    """Requests with fewer than `least` places get the fixture's instead (same columns)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    live = places.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")
    return live.unionByName(fixture.join(live.select("request_id").distinct(), "request_id", "left_anti"))


def shortlist(places: DataFrame, per_area: int = PER_AREA, most: int = SHORTLIST, least: int = AT_LEAST) -> DataFrame:
    """places: request_id, place_id, area_rank (of its source area), distance. Round robin:
    the nearest place of each area in rank order, then the second nearest; where that
    gives fewer than `least`, the nearest of the rest fill up."""
    by_area = Window.partitionBy("request_id", "area_rank").orderBy("distance", "place_id")
    rows = places.withColumn("turn", F.row_number().over(by_area))
    whole = Window.partitionBy("request_id")
    rows = rows.withColumn("_first", F.count_if(F.col("turn") <= per_area).over(whole)).withColumn("_all", F.count(F.lit(1)).over(whole))
    early = F.col("turn") <= per_area
    fill = F.col("_first") < F.least(F.lit(least), F.col("_all"))
    order = Window.partitionBy("request_id").orderBy(F.when(early, 0).otherwise(1), F.when(early, F.col("turn")), F.when(early, F.col("area_rank")), "distance", "place_id")
    rows = rows.where(early | fill).withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= most)
    return rows.drop("turn", "_first", "_all")


def with_routes(places: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Adds route_km and route_min: from routes (request_id, slot, condition, km, minutes)
    where a route exists, else the fallback. places: lat, lng, o_lat, o_lng, slot."""
    km, minutes = route_fallback(F.col("o_lat"), F.col("o_lng"), F.col("lat"), F.col("lng"))
    if routes is None:
        return places.withColumn("route_km", km).withColumn("route_min", minutes).withColumn("route_source", F.lit("fallback"))
    live = routes.where("condition = 'ROUTE_EXISTS' and status is not null").select("request_id", "slot", F.col("km").alias("_km"), F.col("minutes").alias("_min"))
    rows = places.join(live, ["request_id", "slot"], "left")
    return rows.withColumn("route_km", F.coalesce("_km", km)).withColumn("route_min", F.coalesce("_min", minutes)).withColumn("route_source", F.when(F.col("_km").isNotNull(), "live").otherwise("fallback")).drop("_km", "_min")


def restaurant_top(rows: DataFrame, top: int = RESTAURANT_TOP) -> DataFrame:
    """rows: request_id, place_id, area_score, route_min, route_km, rating, review_count,
    typical_min, p90_km, light_p90 -> the best `top` of each request."""
    most = F.max(F.coalesce("review_count", F.lit(0))).over(Window.partitionBy("request_id"))
    fit, time, worth = contextual_fit(F.col("route_min"), F.col("route_km"), F.col("typical_min"), F.col("p90_km"), F.col("light_p90"))
    rows = rows.withColumn("_most", most).withColumn("context_fit", fit).withColumn("quality", poi_quality(F.col("rating"), F.col("review_count"), F.col("_most")))
    rows = rows.withColumn("score", restaurant_score(F.col("area_score"), F.col("context_fit"), F.col("quality")))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc(F.coalesce("review_count", F.lit(0))), "route_km", "place_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("request_id", "rank", "place_id", "score", "context_fit", "quality")


def record_events(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """events: request_id, place_key, action, at -> a row per distinct event with its id and
    whether it is new (`recorded`); repeated and known events change nothing."""
    rows = events.withColumn("event_id", event_id(F.col("request_id"), F.col("place_key"), F.col("action")))
    rows = rows.groupBy("event_id", "request_id", "place_key", "action").agg(F.min("at").alias("at"))
    if existing is None:
        return rows.withColumn("recorded", F.lit(True))
    known = existing.select("event_id", F.lit(True).alias("_known"))
    return rows.join(known, "event_id", "left").withColumn("recorded", F.col("_known").isNull()).drop("_known")
