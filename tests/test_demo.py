import numpy as np
import pytest

from test_areas_release import blobs
from test_clean import record, run
from tripforge.operators import areas, clean, demo, density, release

SCORED = "period string, weekday_class string, area_id string, visits long, area_score double"
POPULAR = "origin_id string, period string, weekday_class string, area_id string, n long"


def tables(spark):
    scored = spark.createDataFrame([("lunch", "weekday", a, v, s) for a, v, s in (("a", 5, 0.1), ("b", 9, 0.2), ("c", 9, 0.9))] + [("night", "weekday", "a", 1, 1.0)], SCORED)
    return scored, spark.createDataFrame([("o", "lunch", "weekday", "a", 3), ("x", "lunch", "weekday", "c", 8)], POPULAR)


def test_known_origins_get_their_favourites(spark):
    scored, popular = tables(spark)
    asked = spark.createDataFrame([("r1", "o", "density", "lunch", "weekday"), ("r2", "area-fallback-taipei", "fallback", "lunch", "weekday"), ("r3", None, None, "night", "weekday"), ("r4", "new", "density", "lunch", "weekday")], "request_id string, origin_id string, assignment string, period string, weekday_class string")
    got = demo.recommend(asked, popular, scored, top=2).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.area_id, r.score, r.fallback_used) for r in got] == [("r1", "a", 3.0, False), ("r1", "b", 0.0, False), ("r2", "c", 0.9, True), ("r2", "b", 0.2, True), ("r3", "a", 1.0, True), ("r4", "b", 0.0, False), ("r4", "c", 0.0, False)]
    assert demo.recommend(asked.limit(0), popular, scored).count() == 0


def test_smoke_metrics(spark):
    rows = [("m", "a", 1), ("m", "b", 4), ("m", "c", 6), ("m", "d", None), ("m", None, None), ("none", None, None)]
    got = {r.model: r for r in demo.smoke_metrics(spark.createDataFrame(rows, "model string, actual string, rank int")).collect()}
    m = got["m"]
    assert (m.rows_in_scope, m.evaluated, m.destination_coverage, m.hit5, m.mrr5) == (5, 4, 0.8, 0.5, (1 + 0.25) / 4)
    assert (got["none"].evaluated, got["none"].hit5, got["none"].destination_coverage) == (0, 0.0, 0.0)


def test_coverage_and_fallbacks(spark):
    rows = [("Taipei", "density", "Taipei", "density"), ("Taipei", "fallback", "Taipei", "fallback"), ("Taichung", "fallback", "Taichung", "fallback"), (None, None, None, None)]
    t = spark.createDataFrame(rows, "pickup_region string, pickup_assignment string, dropoff_region string, dropoff_assignment string")
    c = demo.destination_coverage(t).first()
    assert (c.trips, c.in_region, c.verified, c.destination_coverage) == (4, 2, 1, 0.5)
    assert {(r.side, r.region): r.n for r in demo.fallbacks(t).collect()} == {(s, r): 1 for s in ("pickup", "dropoff") for r in ("Taipei", "Taichung")}
    assert demo.destination_coverage(t.limit(0)).first().destination_coverage == 0.0


def test_endpoints_of_the_first_trips(spark):
    t = spark.createDataFrame([(i, 25.0, 121.5, 24.1 if i == 3 else 25.0, 120.6 if i == 3 else 121.5) for i in (9, 3, 5)], "row_number long, pickup_lat double, pickup_lng double, dropoff_lat double, dropoff_lng double")
    got = areas.endpoint_samples(t, 2).collect()
    assert sorted(r.side for r in got) == ["dropoff", "dropoff", "pickup", "pickup"] and sum(r.lat == 24.1 for r in got) == 1


def test_totals_and_report(spark, tmp_path):
    rows = run(spark, tmp_path, [record(0), record(1, PickUpLatitude="28.0"), record(0), record(3)[:5]])
    trips = clean.clean(rows)
    t = clean.totals(rows, trips).first()
    assert (t.input_rows, t.quarantine_rows, t.clean_rows, t.reconciled, t.boundary_rows) == (4, 3, 1, True, 0)
    text = clean.report(clean.quality(rows, trips), clean.totals(rows, trips))
    assert "- reconciled: True" in text and "| duplicate_trip_id | 1 |" in text


def grid(spark, region=True):
    pts = blobs()
    rows = [(p, i, float(a), float(b), "east" if b > 121.53 else "west") for p in ("some", "all") for i, (a, b) in enumerate(pts) if p == "all" or i < 180]
    points = spark.createDataFrame(rows, "policy string, seq int, lat double, lng double, region string")
    return density.experiment(points if region else points.drop("region"), spark.createDataFrame([(p, 180, 20, 5) for p in ("some", "all")] + [("all", 10**6, 20, 5)], "policy string, size int, min_cluster_size int, min_samples int"))


def test_metrics_of_clusters(spark):
    got = {(r["policy"], r["size"]): r for r in grid(spark).collect()}
    r = got["all", 180]
    assert r.clusters == 3 and set(r.coverage) == {"east", "west"} and 0 < r.radius_p50_km <= r.radius_p90_km < 2
    assert got["all", 10**6].coverage is None and got["all", 10**6].status == "skipped"
    assert all(r.coverage is None for r in grid(spark, region=False).collect())
    at = np.radians(blobs()[:4])
    m = density.metrics(at, np.array([0, 0, 0, -1]))
    centre = at[:3].mean(0)[None]
    assert m["radius_p90_km"] == pytest.approx(np.quantile(density.distances(at[:3], centre)[:, 0], 0.9)) and m["noise_ratio"] == 0.25
    assert density.metrics(at, np.full(4, -1))["radius_p50_km"] is None


def test_deltas_of_policies(spark):
    rows = [("a", 10, 5, 2, "ok", 3, 0.25, {"x": 0.5}), ("b", 10, 5, 2, "ok", 5, 0.5, {"x": 0.75}), ("a", 20, 5, 2, "ok", 1, 0.0, {"x": 0.0}), ("b", 20, 5, 2, "skipped", None, None, None)]
    df = spark.createDataFrame(rows, "policy string, size int, min_cluster_size int, min_samples int, status string, clusters int, noise_ratio double, coverage map<string,double>")
    got = density.policy_deltas(df, "a", "b").collect()
    assert [(r["size"], r.clusters_delta, r.noise_ratio_delta, r.coverage_delta) for r in got] == [(10, 2, 0.25, {"x": 0.25})]


def test_a_model_is_fitted_once_per_contract(spark, tmp_path, monkeypatch):
    sample = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(blobs())], "seq int, lat double, lng double")
    path, fits, fit = f"file://{tmp_path}/model", [], density.fit
    monkeypatch.setattr(density, "fit", lambda *a: fits.append(1) or fit(*a))
    first = density.fit_once(sample, path, {"digest": "1"}, 20, 5)
    again = density.fit_once(sample, path, {"digest": "1"}, 20, 5)
    assert len(fits) == 1 and (again.labels == first.labels).all() and np.allclose(again.reach, first.reach) and (again.points == first.points).all()
    assert (again.predict(first.points, 5) == first.predict(first.points, 5)).all()
    density.fit_once(sample, path, {"digest": "2"}, 20, 5)
    density.fit_once(sample, path, {"digest": "2"}, 21, 5)
    assert len(fits) == 3


def test_availability_of_profiles(spark):
    profiles = spark.createDataFrame([("k1", "full", 20), ("k2", "cold", 1)], "rider_key string, level string, trip_count long")
    got = {r.level: r for r in release.profile_of_alias(release.personas(profiles), profiles).collect()}
    assert got["full"].personal_mobility_available and not got["cold"].personal_mobility_available and not got["light"].personal_mobility_available
    assert not any(r.similar_riders_available for r in got.values())
