import pytest

from tripforge.operators import evaluate, fares, riders, serve, areas
from tripforge.streaming import events as stream


def test_fare_cube_needs_thirty(spark):
    rows = [(3.0, "dinner", "Taipei", 100.0 + i) for i in range(31)] + [(12.0, "dinner", "Taipei", 9.0)]
    cube = fares.fare_cube(spark.createDataFrame(rows, "distance_km double, period string, pickup_region string, fare_midpoint double")).collect()
    assert len(cube) == 4
    assert all((r.distance_bin, r.sample_count, r.fare_p25, r.fare_p75) == ("2-5", 31, 107.5, 122.5) for r in cube)


def test_fare_ladder_takes_the_first_rung(spark):
    cube = spark.createDataFrame([("2-5", "all_periods", "Taipei", 40, 1.0, 2.0), ("2-5", "all_periods", "all_regions", 90, 3.0, 4.0)], "distance_bin string, period string, region string, sample_count long, fare_p25 double, fare_p75 double")
    requests = spark.createDataFrame([(1, 3.0, "lunch", "Taipei"), (2, 3.0, "lunch", "Taichung"), (3, 30.0, "lunch", "Taipei")], "request_id long, distance_km double, period string, region string")
    got = {r.request_id: (r.source, r.fare_p25) for r in fares.fare_ladder(requests, cube).collect()}
    assert got == {1: ("distance_all_periods_region", 1.0), 2: ("distance_only", 3.0), 3: (None, None)}


def places(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "request_id long, place_id string, area_rank int, distance double")


def test_shortlist_goes_round(spark):
    rows = [(f"{a}{i}", r, float(i)) for r, a in enumerate("abc") for i in range(4)]
    got = [r.place_id for r in serve.shortlist(places(spark, rows)).orderBy("slot").collect()]
    assert got == ["a0", "b0", "c0", "a1", "b1", "c1"]


def test_shortlist_fills_from_one_area(spark):
    got = [r.place_id for r in serve.shortlist(places(spark, [(f"p{i}", 1, float(i)) for i in range(6)])).orderBy("slot").collect()]
    assert got == [f"p{i}" for i in range(6)]


def test_fixture_replaces_few_places(spark):
    live = spark.createDataFrame([(1, "x")] * 4 + [(2, "y")] * 5, "request_id long, place_id string")
    fixture = spark.createDataFrame([(r, "f") for r in (1, 2) for _ in range(5)], "request_id long, place_id string")
    got = serve.with_fixture(live, fixture).groupBy("request_id", "place_id").count().collect()
    assert {(r.request_id, r.place_id): r["count"] for r in got} == {(1, "f"): 5, (2, "y"): 5}


def test_events_are_idempotent(spark):
    rows = spark.createDataFrame([("r", "p", "save", 5), ("r", "p", "save", 3), ("r", "p", "hide", 4)], "request_id string, place_key string, action string, at long")
    first = serve.record_events(rows)
    assert first.count() == 2 and first.where("action = 'save'").first().at == 3
    again = serve.record_events(rows, first)
    assert again.where("recorded").count() == 0


def test_routes_fall_back(spark):
    p = spark.createDataFrame([(1, 1, 25.0, 121.5, 25.0, 121.5), (1, 2, 25.1, 121.5, 25.0, 121.5)], "request_id long, slot int, lat double, lng double, o_lat double, o_lng double")
    r = spark.createDataFrame([(1, 1, "ROUTE_EXISTS", "ok", 2.0, 7), (1, 2, "ROUTE_NOT_FOUND", "ok", 9.0, 9)], "request_id long, slot int, condition string, status string, km double, minutes int")
    got = {x.slot: x for x in serve.with_routes(p, r).collect()}
    assert got[1].route_source == "live" and got[1].route_km == 2.0
    assert got[2].route_source == "fallback" and got[2].route_km == pytest.approx(14.46, abs=0.01) and got[2].route_min == 45


def test_neighbours_leave_out_self_and_unlike(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "rider_id long, v array<double>")
    got = riders.cosine_neighbours(v, 2, block=2).orderBy("rider_id", "rank").collect()
    assert [(r.rider_id, r.neighbour) for r in got] == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_b_needs_five_neighbours(spark):
    near = spark.createDataFrame([(1, n, 0.8) for n in range(10, 15)] + [(2, n, 0.8) for n in range(10, 14)], "rider_id long, neighbour long, similarity double")
    visits = spark.createDataFrame([(n, a, "dinner", c) for n in range(10, 15) for a, c in ((7, 3), (8, 1))], "rider_id long, area_id long, period string, visits long")
    scale = spark.createDataFrame([(0.0, 2.0)], "p5 double, p95 double")
    got = evaluate.b_scores(spark.createDataFrame([(1,), (2,)], "rider_id long"), near, visits, scale).collect()
    assert {(r.rider_id, r.area_id): round(r.b_score, 6) for r in got} == {(1, 7): 0.693147, (1, 8): 0.346574}


def test_grid_sizes():
    names = [m for m, *_ in evaluate.weight_grid()]
    assert [names.count(m) for m in ("area_a_plus_c", "area_a_plus_b", "area_a_plus_b_plus_c")] == [7, 7, 21]


def test_all_models_and_weightings_against_brute_force(spark):
    import math
    import random
    from collections import defaultdict

    r = random.Random(6)
    near = [(i, n, r.random()) for i in (1, 2) for n in range(10, 16)] + [(3, n, 0.5) for n in range(10, 14)] + [(3, 14, 0.0)]
    visits = [(n, a, p, r.randint(1, 30)) for n in range(10, 16) for a in range(8) for p in ("dinner", "lunch") if r.random() < 0.4]
    p5, p95 = 0.1, 1.1
    rows, b = [], {}
    for trip in range(40):
        rider, period, actual = trip % 3 + 1, ("dinner", "lunch", "night")[trip % 4 % 3], r.randrange(9)
        c = trip % 5 > 0
        for area in range(9):
            rows.append((trip, rider, period, area, actual, 1.0, r.randrange(50), r.randrange(50), r.random(), r.random() if c else None))
            mine = [(n, s) for i, n, s in near if i == rider and s > 0]
            raw = sum(s * math.log1p(v) for n, s in mine for m, a, p, v in visits if (m, a, p) == (n, area, period))
            b[trip, area] = min(1, max(0, (raw / sum(s for _, s in mine) - p5) / (p95 - p5))) if len(mine) >= 5 else None
    df = spark.createDataFrame(rows, "trip_id long, rider_id long, period string, candidate long, actual long, distance double, global_score long, origin_score long, a_score double, c_score double")
    got = evaluate.with_b(
        df, spark.createDataFrame([(1,), (2,), (3,)], "rider_id long"), spark.createDataFrame(near, "rider_id long, neighbour long, similarity double"),
        spark.createDataFrame(visits, "rider_id long, area_id long, period string, visits long"), spark.createDataFrame([(p5, p95)], "p5 double, p95 double"),
    ).cache()
    for x in got.collect():
        assert x.b_score == (None if b[x.trip_id, x.candidate] is None else pytest.approx(b[x.trip_id, x.candidate]))

    def place(score, trip):
        order = sorted((x for x in rows if x[0] == trip), key=lambda x: (-round(score(x), 9), x[3]))
        return next(k for k, x in enumerate(order, 1) if x[3] == x[4])

    def mean(w, x):
        parts = [(k, v) for k, v in zip(w, (x[8], b[x[0], x[3]], x[9])) if k > 0 and v is not None]
        return sum(k * v for k, v in parts) / sum(k for k, _ in parts)

    tuned = {(x.model, x.weights): x for x in evaluate.tune(got, digits=9).collect()}
    assert len(tuned) == 35
    for m, *w in evaluate.weight_grid():
        trips = [t for t in range(40) if (not w[1] or b[t, 0] is not None) and (not w[2] or t % 5)]
        at = [place(lambda x: mean(w, x), t) for t in trips]
        x = tuned[m, "%.1f/%.1f/%.1f" % tuple(w)]
        assert x.questions == len(trips) > 0 and x.hit5 == pytest.approx(sum(k <= 5 for k in at) / len(at)) and x.mrr5 == pytest.approx(sum(1 / k for k in at if k <= 5) / len(at))

    weights = evaluate.DEFAULT_WEIGHTS
    score = {"global_popularity": lambda x: x[6], "origin_period": lambda x: x[7], "area_a": lambda x: x[8]} | {m: lambda x, w=w: mean(w, x) for m, w in weights.items()}
    found = defaultdict(dict)
    for x in evaluate.metrics(evaluate.ranked(evaluate.long_scores(got, weights), ["trip_id", "model"], 9), 9, ["period"]).collect():
        found[x.model][x.value] = x
    assert set(found) == set(evaluate.MODELS)
    for m in found:
        at = [place(score[m], t) for t in range(40)]
        assert found[m]["all"].questions == 40 and found[m]["all"].hit5 == pytest.approx(sum(k <= 5 for k in at) / 40) and found[m]["all"].mrr5 == pytest.approx(sum(1 / k for k in at if k <= 5) / 40)


def test_missing_truth_counts_as_hit_among_few_candidates(spark):
    rows = spark.createDataFrame([(1, c, 99, 0.5, None, 0.5) for c in range(3)], "trip_id long, candidate long, actual long, a_score double, b_score double, c_score double")
    assert evaluate.tune(rows).where("rank = 1").first().hit5 == 1.0
    assert evaluate.tune(rows, strict=True).where("rank = 1").first().hit5 == 0.0


def test_sample_is_a_prefix_of_a_larger_one(spark):
    points = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(100)], "k long, region string")
    small = {r.k for r in areas.stratified_sample(points, 20, "k").collect()}
    large = {r.k for r in areas.stratified_sample(points, 50, "k").collect()}
    assert small < large and len(large) == 50 and sum(k < 60 for k in large) == 30


def test_sample_against_plain_order(spark):
    import hashlib

    rows = [(k, "abc"[min(k % 7, 2)] if k % 50 else None) for k in range(400)] + [(None, "a"), (7, "a"), (7, "b")]
    points = spark.createDataFrame(rows, "k long, region string")
    by = {}
    for k, region in rows:
        by.setdefault(region, []).append(("" if k is None else hashlib.sha256(str(k).encode()).hexdigest(), -1 if k is None else k))
    order = sorted(((r / len(v), region or "", h, k) for region, v in by.items() for r, (h, k) in enumerate(sorted(v))))
    for size in (1, 3, 40, 400, 1000):
        got = [(x.region or "", -1 if x.k is None else x.k) for x in areas.stratified_sample(points, size, "k").collect()]
        assert sorted(got) == sorted((region, k) for _, region, _, k in order[:size])
    assert areas.stratified_sample(points.where("k < 0"), 5, "k").count() == 0


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("r", "p", "save", 5), ("r", "p", "save", 3), ("r", "q", "save", 4)], "request_id string, place_key string, action string, s long")
    rows.selectExpr("request_id", "place_key", "action", "timestamp_seconds(s) AS at").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("request_id string, place_key string, action string, at timestamp").parquet(str(tmp_path / "in"))
    q = stream.deduplicated(source).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("events_out").count() == 2
