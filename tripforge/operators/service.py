"""The composed services over batches of requests: recommendations and ride estimates.

Places and routes come as tables, as providers are no part of the engine: what a provider
was asked for and answered is a row of them. All requests of a batch are answered by one
plan; per-request limits are windows over the request, which is small by its own limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripforge.functions.calendar import serving_period_of_hour, weekday_class
from tripforge.functions.geo import haversine_km
from tripforge.functions.scoring import distance_budget_km, distance_fit_serving, event_id, explanation, mobility_score
from tripforge.operators import fares, serve
from tripforge.sources.scratch import stored

#: Candidates and provider calls of a request, rows below which a search is
#: repeated in a wider circle, and the share of proximity in the area score.
CANDIDATES, CALLS, FEW_ROWS, PROXIMITY = 150, 10, 10, 0.20
LEAST_KM = 5.0


def with_context(requests: DataFrame) -> DataFrame:
    """requests: request_id, at (timestamp, in the session's zone) -> period, weekday_class."""
    return requests.withColumn("period", serving_period_of_hour(F.hour("at"))).withColumn("weekday_class", weekday_class(F.col("at")))


def origins(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """Adds nearest_area_id, origin_fallback (the nearest centre is farther than twice the
    area's radius, and than LEAST_KM), origin_area_id (null then) and region."""
    near = serve.nearest_area(requests, areas, "request_id").select("request_id", F.col("area_id").alias("nearest_area_id"), "km")
    of = areas.select(F.col("area_id").alias("nearest_area_id"), "radius_p90_km", F.col("region").alias("origin_region"))
    rows = requests.join(near, "request_id", "left").join(of, "nearest_area_id", "left")
    far = F.col("km") > F.greatest(2.0 * F.coalesce("radius_p90_km", F.lit(0.0)), F.lit(LEAST_KM))
    return rows.withColumn("origin_fallback", far).withColumn("origin_area_id", F.when(~far, F.col("nearest_area_id"))).drop("km", "radius_p90_km")


def ranked_areas(requests: DataFrame, areas: DataFrame, stats: DataFrame, profiles: DataFrame, rider_areas: DataFrame, cohort: DataFrame, weights: tuple[float, float] = (0.30, 0.70)) -> DataFrame:
    """The ten best areas of each request in its distance budget: request_id, area_id,
    rank, score, distance_km, area_attraction, personal_mobility, budget_km. requests: with
    rider_id (null for new riders), lat, lng, period, weekday_class; stats: area_id,
    period, weekday_class, area_score; profiles and rider_areas as `riders` makes them;
    cohort: one row of p25, p75, p90 of light riders, or none."""
    own = ["trip_count", "level", "median_km", "p25_km", "p75_km", "p90_km", "weekend_ratio", *[f"{p}_ratio" for p in ("morning", "lunch", "afternoon", "dinner", "night")]]
    rows = requests.join(profiles.select("rider_id", *own), "rider_id", "left").withColumn("budget_km", distance_budget_km(F.col("level"), F.col("median_km")))
    rows = serve.in_budget(rows, areas).join(stats, ["area_id", "period", "weekday_class"])
    visits = rider_areas.select("rider_id", "area_id", "period", "visits")
    most = visits.groupBy("rider_id", "period").agg(F.max("visits").alias("most"))
    rows = rows.join(visits, ["rider_id", "area_id", "period"], "left").join(most, ["rider_id", "period"], "left")
    light = cohort.select(F.col("p25").alias("l25"), F.col("p75").alias("l75"), F.col("p90").alias("l90")).limit(1)
    rows = rows.join(F.broadcast(light), F.lit(True), "left")  # one row, or none
    full = F.col("level") == "full"
    p25, p75 = (F.when(full, F.col(f"p{q}_km")).otherwise(f("median_km", f"l{q}")) for q, f in ((25, F.least), (75, F.greatest)))
    p90 = F.when(full, F.col("p90_km")).otherwise(F.greatest(p75 + 0.1, F.col("l90")))
    ratio = F.coalesce(*[F.when(F.col("period") == p, F.col(f"{p}_ratio")) for p in ("morning", "lunch", "afternoon", "dinner", "night")])
    score = mobility_score(distance_fit_serving(F.col("distance"), p25, p75, p90), ratio, F.col("weekend_ratio"), F.col("trip_count"), F.col("weekday_class"), F.coalesce("visits", F.lit(0)), F.coalesce("most", F.lit(0)))
    rows = rows.withColumn("c_score", F.when(F.col("level").isin("full", "light"), score))
    c = F.col("c_score")
    base = F.when(c.isNull(), F.col("area_score")).otherwise(weights[0] * F.col("area_score") + weights[1] * c)
    near = serve.proximity_fit(F.col("distance"), F.col("budget_km"))
    rows = rows.withColumn("score", F.round(serve.area_blend(base, near, PROXIMITY), 6))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "area_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= serve.AREA_TOP)
    return rows.select("request_id", "area_id", "rank", "score", F.round("distance", 4).alias("distance_km"), F.round("area_score", 6).alias("area_attraction"), F.round("c_score", 6).alias("personal_mobility"), "budget_km")


def found_places(ranked: DataFrame, searches: DataFrame) -> DataFrame:
    """What the providers' answers come to. searches: area_id, wide (the second, wider
    circle), seq, place_id, lat, lng, open_status, ..; areas are asked in rank order, the
    wider circle where the first gives some rows but fewer than FEW_ROWS, until CALLS calls
    are made or CANDIDATES open places are there. Each place comes from the area of its
    highest score, first seen."""
    n = searches.groupBy("area_id").agg(F.count_if(~F.col("wide")).alias("narrow"))
    asked = ranked.join(n, "area_id", "left").withColumn("narrow", F.coalesce("narrow", F.lit(0)))
    before = Window.partitionBy("request_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    again = (F.col("narrow") > 0) & (F.col("narrow") < FEW_ROWS)
    asked = asked.withColumn("made", F.coalesce(F.sum(1 + again.cast("int")).over(before), F.lit(0)))
    asked = asked.where(F.col("made") < CALLS).withColumn("use_wide", again & (F.col("made") + 1 < CALLS))
    answers = stored(_answers(searches).withColumnRenamed("seq", "_seq"), "answers")
    places = asked.select("request_id", "area_id", "rank", "score", F.col("use_wide").alias("wide")).join(answers, ["area_id", "wide"])
    # the windows below are all of a request: one shuffle serves them
    places = places.repartition("request_id")
    seen = Window.partitionBy("request_id", "place_id").orderBy("rank", "_seq")
    places = places.withColumn("_turn", F.row_number().over(seen))
    so_far = F.sum(F.when(F.col("_turn") == 1, 1).otherwise(0)).over(Window.partitionBy("request_id").orderBy("rank", "_seq", "place_id").rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("_there", F.coalesce(so_far, F.lit(0))).where(F.col("_there") < CANDIDATES)
    best = Window.partitionBy("request_id", "place_id").orderBy(F.desc("score"), "rank", "_seq")
    places = places.withColumn("_best", F.row_number().over(best)).where("_best = 1")
    return places.withColumnRenamed("rank", "area_rank").withColumnRenamed("score", "area_score").drop("_turn", "_there", "_best", "_seq", "wide")


def _answers(searches: DataFrame) -> DataFrame:
    """Of each search (area_id, wide) the rows that can matter to a request: the first open
    one of each place, and of these the first CANDIDATES. A later row of a place is neither
    its first nor its best, as the search has one score; and with CANDIDATES places before
    it in its own search, a row is beyond the bound in any request."""
    first = Window.partitionBy("area_id", "wide", "place_id").orderBy("seq")
    rows = searches.where(F.coalesce(F.col("open_status"), F.lit("")) != "closed").withColumn("_first", F.row_number().over(first)).where("_first = 1")
    order = Window.partitionBy("area_id", "wide").orderBy("seq", "place_id")
    return rows.withColumn("_first", F.row_number().over(order)).where(F.col("_first") <= CANDIDATES).drop("_first")


def recommend(requests: DataFrame, ranked: DataFrame, searches: DataFrame, fixture: DataFrame, cohort: DataFrame, profiles: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """The five best places of each request: request_id, rank, place_key, area_id, score,
    score_breakdown, restaurant_source, route_source, distance_km, minutes, explanation.
    requests: with lat, lng, period, rider_id, origin_fallback; ranked: `ranked_areas`;
    fixture: place_id, lat, lng, rating, review_count, for requests with fewer than five
    places, placed in their first area."""
    columns = ["request_id", "place_id", "area_id", "area_rank", "area_score", "lat", "lng", "rating", "review_count"]
    live = stored(found_places(ranked, searches).select(*columns), "found")  # read twice, as is the shortlist
    first = ranked.where("rank = 1").select("request_id", "area_id", F.col("rank").alias("area_rank"), F.col("score").alias("area_score"))
    instead = first.crossJoin(F.broadcast(fixture.select("place_id", "lat", "lng", "rating", "review_count")))  # a dozen rows
    places = serve.with_fixture(live.withColumn("restaurant_source", F.lit("live")), instead.select(*columns, F.lit("fallback_fixture").alias("restaurant_source")))
    of = requests.select("request_id", F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), "period", "rider_id")
    places = places.join(of, "request_id").withColumn("distance", haversine_km(F.col("o_lat"), F.col("o_lng"), F.col("lat"), F.col("lng")))
    short = serve.with_routes(serve.shortlist(places), routes)
    short = short.join(profiles.select("rider_id", F.col("median_min").alias("typical_min"), "p90_km"), "rider_id", "left").join(F.broadcast(cohort.select(F.col("p90").alias("light_p90")).limit(1)), F.lit(True), "left")  # one row, or none
    short = stored(short, "short")
    top = serve.restaurant_top(short)
    info = short.select("request_id", "place_id", "area_id", "area_score", "restaurant_source", "route_source", "route_km", "route_min", "period")
    rows = top.join(info, ["request_id", "place_id"]).join(ranked.select("request_id", "area_id", "area_attraction", "personal_mobility"), ["request_id", "area_id"])
    breakdown = F.struct("area_attraction", F.lit(None).cast("double").alias("similar_riders"), "personal_mobility", "context_fit", F.col("quality").alias("poi_quality"))
    return rows.select("request_id", "rank", F.col("place_id").alias("place_key"), "area_id", "score", breakdown.alias("score_breakdown"), "restaurant_source", "route_source", F.col("route_km").alias("distance_km"), F.col("route_min").alias("minutes"), explanation(F.col("period"), F.col("personal_mobility")).alias("explanation"))


def records(requests: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Rows to append: a request each, its items, and an impression of each item."""
    source = items.groupBy("request_id").agg(F.first("restaurant_source").alias("restaurant_source"))
    shown = items.select("request_id", "place_key", F.lit("impression").alias("action"))
    return {
        "recommendation_requests": requests.select("request_id", "rider_id", "origin_area_id", "at").join(source, "request_id", "left"),
        "recommendation_items": items.select("request_id", "rank", "place_key", "area_id", F.col("score").alias("final_score"), F.to_json("score_breakdown").alias("score_breakdown_json")),
        "feedback_events": shown.withColumn("event_id", event_id(F.col("request_id"), F.col("place_key"), F.col("action"))),
    }


def warnings(requests: DataFrame, items: DataFrame, provider: DataFrame) -> DataFrame:
    """request_id, warnings: for fixture places, of the providers (request_id, seq, warning;
    each once, in order), and for an origin outside all areas."""
    first = items.groupBy("request_id").agg(F.first("restaurant_source").alias("source"))
    once = provider.groupBy("request_id", "warning").agg(F.min(F.struct("seq")).alias("s")).select("request_id", F.col("s.seq").alias("seq"), "warning")
    told = once.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "warning"))), lambda x: x["warning"]).alias("told"))
    rows = requests.join(first, "request_id", "left").join(told, "request_id", "left")
    some = lambda x, text: F.when(x, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    return rows.select("request_id", F.concat(some(F.col("source") == "fallback_fixture", "fixture_places"), F.coalesce("told", F.array().cast("array<string>")), some(F.col("origin_fallback"), "origin_fallback")).alias("warnings"))


def estimate_ride(asked: DataFrame, items: DataFrame, areas: DataFrame, cube: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """asked: ride_id, request_id, place_key, o_lat, o_lng, lat, lng, at -> ride_id, error
    (REQUEST_NOT_FOUND, PLACE_NOT_IN_REQUEST or null), distance_km, minutes, route_source
    and the fare range of the first rung that has one. Routes: request_id (a ride_id), slot
    (0), condition, status, km, minutes."""
    known = items.select("request_id").distinct().withColumn("_request", F.lit(True))
    there = items.select("request_id", "place_key").distinct().withColumn("_place", F.lit(True))
    rows = asked.join(known, "request_id", "left").join(there, ["request_id", "place_key"], "left")
    rows = rows.withColumn("error", F.when(F.col("_request").isNull(), "REQUEST_NOT_FOUND").when(F.col("_place").isNull(), "PLACE_NOT_IN_REQUEST"))
    near = serve.nearest_area(asked.select("ride_id", F.col("o_lat").alias("lat"), F.col("o_lng").alias("lng")), areas, "ride_id").select("ride_id", "area_id")
    rows = rows.join(near.join(areas.select("area_id", "region"), "area_id"), "ride_id", "left").withColumn("period", serving_period_of_hour(F.hour("at")))
    routed = serve.with_routes(rows.where("error is null").select(F.col("ride_id").alias("request_id"), F.lit(0).alias("slot"), "o_lat", "o_lng", "lat", "lng", "period", "region"), routes)
    fare = fares.fare_ladder(routed.select("request_id", F.col("route_km").alias("distance_km"), "period", "region"), cube)
    done = routed.join(fare.drop("distance_bin"), "request_id", "left").select(F.col("request_id").alias("ride_id"), F.col("route_km").alias("distance_km"), F.col("route_min").alias("minutes"), "route_source", F.col("fare_p25").alias("fare_lower"), F.col("fare_p75").alias("fare_upper"), "sample_count", F.col("source").alias("fare_source"))
    return rows.select("ride_id", "request_id", "place_key", "error").join(done, "ride_id", "left")
