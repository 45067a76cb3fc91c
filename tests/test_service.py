from pyspark.sql import functions as F

from tripforge.operators import service


def areas(spark):
    rows = [("a", 25.00, 121.50, 1.0, "Taipei"), ("b", 25.02, 121.50, 1.0, "Taipei"), ("c", 25.30, 121.50, 1.0, "Taipei")]
    return spark.createDataFrame(rows, "area_id string, lat double, lng double, radius_p90_km double, region string")


def requests(spark):
    rows = [("r1", None, 25.0, 121.5, "2026-09-17 18:30:00"), ("r2", 7, 25.0, 121.5, "2026-09-19 02:00:00"), ("far", None, 26.0, 121.5, "2026-09-17 18:30:00")]
    df = spark.createDataFrame(rows, "request_id string, rider_id long, lat double, lng double, t string")
    return service.origins(service.with_context(df.withColumn("at", F.to_timestamp("t")).drop("t")), areas(spark))


def ranked(spark):
    stats = spark.createDataFrame([(a, p, w, s) for a, s in (("a", 0.5), ("b", 0.9), ("c", 1.0)) for p in ("morning", "dinner") for w in ("weekday", "weekend")], "area_id string, period string, weekday_class string, area_score double")
    kept = [7, 12, "full", 4.0, 2.0, 6.0, 9.0, 30.0, 0.5, 0.2, 0.2, 0.2, 0.2, 0.2]
    profiles = spark.createDataFrame([kept], "rider_id long, trip_count long, level string, median_km double, p25_km double, p75_km double, p90_km double, median_min double, weekend_ratio double, morning_ratio double, lunch_ratio double, afternoon_ratio double, dinner_ratio double, night_ratio double")
    visits = spark.createDataFrame([(7, "a", "morning", 5)], "rider_id long, area_id string, period string, visits long")
    cohort = spark.createDataFrame([(1.0, 5.0, 8.0)], "p25 double, p75 double, p90 double")
    return service.ranked_areas(requests(spark), areas(spark), stats, profiles, visits, cohort), profiles, cohort


def test_origins(spark):
    got = {r.request_id: r for r in requests(spark).collect()}
    assert (got["r1"].origin_area_id, got["r1"].origin_fallback, got["r1"].period, got["r1"].weekday_class) == ("a", False, "dinner", "weekday")
    assert (got["r2"].period, got["r2"].weekday_class) == ("morning", "weekend")
    assert got["far"].origin_fallback and got["far"].origin_area_id is None and got["far"].nearest_area_id == "c"


def test_areas_in_reach(spark):
    rows = ranked(spark)[0].orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.area_id) for r in rows if r.request_id == "r1"] == [("r1", "b"), ("r1", "a")]
    assert all(r.personal_mobility is None for r in rows if r.request_id == "r1") and all(r.personal_mobility > 0 for r in rows if r.request_id == "r2")


def search_rows(spark, per):
    rows = [(a, wide, i, f"{a}{i}", 25.0 + i / 1000, 121.5, "closed" if i == 0 else None, 4.0, 10 * i) for a, wide, n in per for i in range(n)]
    return spark.createDataFrame(rows, "area_id string, wide boolean, seq int, place_id string, lat double, lng double, open_status string, rating double, review_count long")


def test_a_search_with_few_rows_is_repeated(spark):
    places = service.found_places(ranked(spark)[0].where("request_id = 'r1'"), search_rows(spark, [("b", False, 3), ("b", True, 12), ("a", False, 11), ("a", True, 30)]))
    found = {}
    for r in places.collect():
        found.setdefault(r.area_id, set()).add(r.place_id)
    assert found == {"b": {f"b{i}" for i in range(1, 12)}, "a": {f"a{i}" for i in range(1, 11)}}


def test_candidates_and_calls_are_bounded(spark):
    many = spark.createDataFrame([("r", f"x{i:02}", i + 1, 1.0 - i / 100) for i in range(10)], "request_id string, area_id string, rank int, score double")
    full = service.found_places(many, search_rows(spark, [(f"x{i:02}", False, 61) for i in range(10)]))
    assert full.count() == service.CANDIDATES
    few = service.found_places(many, search_rows(spark, [(f"x{i:02}", w, 2) for i in range(10) for w in (False, True)]))
    assert {r.area_id for r in few.collect()} == {f"x{i:02}" for i in range(5)}  # two calls each


def test_only_answers_that_can_matter_meet_requests(spark):
    """A place that a provider names a thousand times is a row of a search, and no more than
    CANDIDATES places of a search meet a request."""
    rows = [("a", False, i, f"p{i % 200}", 25.0, 121.5, None, 4.0, i) for i in range(20_000)]
    found = spark.createDataFrame(rows, "area_id string, wide boolean, seq int, place_id string, lat double, lng double, open_status string, rating double, review_count long")
    assert service._answers(found).count() == service.CANDIDATES
    asked = spark.createDataFrame([(f"r{i}", "a", 1, 0.5) for i in range(3)], "request_id string, area_id string, rank int, score double")
    got = service.found_places(asked, found).collect()
    assert len(got) == 3 * service.CANDIDATES and all(r.place_id == f"p{r.review_count}" for r in got)  # each as first seen
    told = spark.createDataFrame([("r0", i, f"w{(i + 2) % 3}") for i in range(3000)], "request_id string, seq int, warning string")
    said = service.warnings(asked.select("request_id", F.lit(False).alias("origin_fallback")), found.limit(0).select(F.lit("").alias("request_id"), F.lit("").alias("restaurant_source")), told)
    assert said.where("request_id = 'r0'").first().warnings == ["w2", "w0", "w1"]


def test_recommend_and_estimate(spark):
    top, profiles, cohort = ranked(spark)
    fixture = spark.createDataFrame([(f"f{i}", 25.0, 121.5 + i / 100, 4.0, 5) for i in range(6)], "place_id string, lat double, lng double, rating double, review_count long")
    items = service.recommend(requests(spark), top, search_rows(spark, [("b", False, 12)]).where("area_id <> ''"), fixture, cohort, profiles)
    got = items.collect()
    assert {r.request_id for r in got} == {"r1", "r2"} and all(1 <= r.rank <= 5 and r.restaurant_source == "live" for r in got) and len(got) == 10
    alone = service.recommend(requests(spark), top, search_rows(spark, [("b", False, 3)]), fixture, cohort, profiles)
    assert {r.restaurant_source for r in alone.collect()} == {"fallback_fixture"}
    out = service.records(requests(spark), items)
    assert out["recommendation_requests"].count() == 3 and out["recommendation_items"].count() == out["feedback_events"].select("event_id").distinct().count() == 10
    told = spark.createDataFrame([("r1", 2, "slow"), ("r1", 1, "late"), ("r1", 3, "slow")], "request_id string, seq int, warning string")
    said = {r.request_id: r.warnings for r in service.warnings(requests(spark), alone, told).collect()}
    assert said == {"r1": ["fixture_places", "late", "slow"], "r2": ["fixture_places"], "far": ["origin_fallback"]}
    cube = spark.createDataFrame([("0-2", "all_periods", "Taipei", 40, 100.0, 150.0)], "distance_bin string, period string, region string, sample_count long, fare_p25 double, fare_p75 double")
    asked = [("x", "r1", got[0].place_key), ("y", "r1", "nowhere"), ("z", "none", "p")]
    asked = spark.createDataFrame([(*a, 25.0, 121.5, 25.001, 121.5) for a in asked], "ride_id string, request_id string, place_key string, o_lat double, o_lng double, lat double, lng double")
    fare = {r.ride_id: r for r in service.estimate_ride(asked.withColumn("at", F.lit("2026-09-17 18:30:00").cast("timestamp")), items.where("request_id = 'r1'").withColumn("place_key", F.lit(got[0].place_key)), areas(spark), cube).collect()}
    assert (fare["x"].error, fare["x"].fare_lower, fare["x"].fare_source, fare["x"].minutes) == (None, 100.0, "distance_all_periods_region", 5)
    assert (fare["y"].error, fare["z"].error) == ("PLACE_NOT_IN_REQUEST", "REQUEST_NOT_FOUND") and fare["y"].fare_lower is None
