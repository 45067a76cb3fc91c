"""Request fields, providers behind a local stub, ordered digests, demo evidence."""

import datetime as dt
import hashlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tripforge.functions import requests
from tripforge.operators import demo, digests, serve
from tripforge.sources import providers

TIMES = [
    "2026-09-17T18:30:00+08:00", "2026-09-20T00:10+08:00", "2026-09-19T23:59:59.25Z", "2026-09-20 03:00:00-05:30", "2026-09-17T18:30:00", "2026-02-30T10:00:00Z", "2026-09-17T24:00:00Z",
    "2026-09-17", "", None, "2026-09-17T10:61:00Z", "2026-09-17T10:00:00+0800",
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Taipei", "America/New_York"])
def test_times_keep_their_own_offset(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        t = requests.own_time(F.col("t"))
        period, day = requests.own_context(t)
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(TIMES)], "i int, t string").select("i", F.unix_micros(t["at"]).alias("us"), t["hour"].alias("h"), period.alias("p"), day.alias("d")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for r, text in zip(rows, TIMES, strict=True):
        try:
            at = dt.datetime.fromisoformat(text) if text and len(text) > 10 else None
        except ValueError:
            at = None
        if at is None or at.tzinfo is None:
            assert r.us is None and r.p is None and r.d is None
            continue
        assert r.us == round(at.timestamp() * 1_000_000) and r.h == at.hour
        assert r.d == ("weekend" if at.weekday() >= 5 else "weekday")
        assert r.p == next(p for p, h in (("morning", 11), ("lunch", 14), ("afternoon", 17), ("dinner", 21), ("night", 24)) if at.hour < h)


def test_errors_of_requests(spark):
    good = ("demo_rider_full", "x", 25.0478, 121.5170, "2026-09-17T18:30:00+08:00")
    bad = [("demo_rider_x", *good[1:]), (good[0], "", *good[2:]), (good[0], "x" * 81, *good[2:]), (*good[:2], 24.79, *good[3:]), (*good[:3], None, good[4]), (*good[:4], "2026-09-17T18:30:00"), (None, None, None, None, None)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate([good, *bad])], "i int, a string, n string, lat double, lng double, t string")
    got = [r.e for r in rows.select("i", requests.recommendation_errors(F.col("a"), F.col("n"), F.col("lat"), F.col("lng"), F.col("t")).alias("e")).orderBy("i").collect()]
    names = ["rider_alias", "location.name", "location.latitude", "location.longitude", "datetime"]
    assert got == [[], ["rider_alias"], ["location.name"], ["location.name"], ["location.latitude"], ["location.longitude"], ["datetime"], names]
    rid = "rec_" + "0" * 15
    rows = spark.createDataFrame([(1, f"{rid}a", "p", "ride_clicked"), (2, rid, "", "clicked"), (3, f"{rid}g", None, None)], "i int, r string, p string, a string")
    got = [r.e for r in rows.select("i", requests.feedback_errors(F.col("r"), F.col("p"), F.col("a")).alias("e")).orderBy("i").collect()]
    assert got == [[], ["request_id", "place_key", "action"], ["request_id", "place_key", "action"]]
    place = (F.lit("x"), F.lit(25.0), F.lit(121.5))
    ride = rows.select("i", requests.ride_errors(F.col("r"), F.col("p"), place, (F.lit("x"), F.lit(26.0), F.lit(121.5)), F.lit(good[4])).alias("e")).orderBy("i")
    assert ride.first().e == ["destination.latitude"]


def test_settings_of_a_release(spark):
    texts = ['{"weights": {"a": 0.4, "c": 0.6}, "cohort_distance_reference": {"light": {"p50": 3}}}', "{}", None, "no json", "[1]", '{"weights": 3, "cohort_distance_reference": []}', '{"weights": {"a": 1}}', '{"weights": {"a": "x"}}']
    c = requests.serving_config(F.col("t"))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", c["weights"].alias("w"), c["cohort"].alias("h"), requests.weight(c, "a").alias("a"), requests.weight(c, "c").alias("c")).orderBy("i").collect()
    assert [r.w for r in rows] == [{"a": 0.4, "c": 0.6}, {}, {}, {}, {}, {"a": 0.3, "c": 0.7}, {"a": 1.0}, {}]
    assert [(r.a, r.c) for r in rows] == [(0.4, 0.6)] + 5 * [(0.3, 0.7)] + [(1.0, 0.7), (0.3, 0.7)]
    assert json.loads(rows[0].h["light"]) == {"p50": 3} and all(not r.h for r in rows[1:])


def test_durations(spark):
    texts = ["600s", "0s", "12.5s", "89.6s", "90s", "150s", "x", None, "1e3s", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", requests.duration_seconds(F.col("t")).alias("s"), requests.route_minutes(F.col("t")).alias("m")).orderBy("i").collect()
    plain = lambda t: round(float(t.rstrip("s"))) if t and t not in ("x",) else None
    assert [r.s for r in rows] == [plain(t) for t in texts]
    assert [r.m for r in rows] == [None if plain(t) is None else max(1, round(plain(t) / 60)) for t in texts]


class Stub(BaseHTTPRequestHandler):
    asked: list = []
    seen: dict = {}

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        Stub.asked.append((self.path, json.loads(body), self.headers["X-Api-Key"]))
        n = Stub.seen[self.path, body] = Stub.seen.get((self.path, body), 0) + 1
        what = self.path.strip("/")
        code = {"once": 503 if n == 1 else 200, "never": 500, "denied": 403, "busy": 429}.get(what, 200)
        if what == "slow" and n == 1:
            time.sleep(1.5)
        place = lambda i, **more: {"id": f"p{i}", "displayName": {"text": "n"}, "location": {"latitude": 25.0, "longitude": 121.5}, **more}
        answer = {"places": [place(1, currentOpeningHours={"openNow": True}, rating=4.5, userRatingCount=9), place(2), place(1, rating=1), {"id": "p3"}, place(4, location={}), place(5, currentOpeningHours={"openNow": False}), place(6, displayName=None)]}
        if what == "matrix":
            answer = [{"destinationIndex": 1, "condition": "ROUTE_EXISTS", "status": {}, "distanceMeters": 2346, "duration": "610s"}, {"destinationIndex": 0, "condition": "ROUTE_NOT_FOUND", "status": {}}, {"destinationIndex": 2, "condition": "ROUTE_EXISTS", "distanceMeters": 5, "duration": "1s"}, {"destinationIndex": 3, "condition": "ROUTE_EXISTS", "status": {}, "duration": "1s"}]
        if what == "route":
            answer = {"routes": [{"distanceMeters": 1999, "duration": "20s"}]}
        data = b"no json" if what == "broken" else json.dumps(answer).encode()
        try:
            self.send_response(code)
            self.end_headers()
            self.wfile.write(data)
        except OSError:
            pass

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def stub():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def centres(spark):
    rows = spark.createDataFrame([("a", 25.0, 121.5, 3000), ("b", 25.1, 121.6, 90_000), ("c", 25.2, 121.7, 0)], "area_id string, lat double, lng double, radius int")
    return rows.select("area_id", providers.place_body(F.col("lat"), F.col("lng"), F.col("radius")).alias("body")).repartition(2)


def test_places_of_a_provider(spark, stub):
    Stub.asked.clear()
    got = providers.ask(centres(spark), f"{stub}/places", "key", providers.PLACE_FIELDS)
    rows = providers.places(got, ["area_id"]).orderBy("area_id", "seq").collect()
    assert [(r.area_id, r.place_id, r.open_status) for r in rows][:3] == [("a", "p1", "open"), ("a", "p2", "unknown"), ("a", "p5", "closed")] and len(rows) == 9
    assert rows[0].rating == 4.5 and rows[0].review_count == 9
    circles = sorted({b["locationRestriction"]["circle"]["radius"] for _, b, _ in Stub.asked})
    assert circles == [1, 3000, 50_000] and {k for *_, k in Stub.asked} == {"key"} and all(b["maxResultCount"] == 15 for _, b, _ in Stub.asked)


@pytest.mark.parametrize(("path", "answered", "calls"), [("once", 3, 6), ("slow", 3, 6), ("never", 0, 6), ("busy", 0, 6), ("denied", 0, 3)])
def test_one_retry(spark, stub, path, answered, calls):
    Stub.asked.clear()
    Stub.seen.clear()
    said = providers.ask(centres(spark), f"{stub}/{path}", "key", providers.PLACE_FIELDS, timeout=1.0).collect()
    assert sum(r.answer is not None for r in said) == answered and len(Stub.asked) == calls


def test_answers_that_are_no_json_and_no_key(spark, stub):
    assert providers.places(providers.ask(centres(spark), f"{stub}/broken", "key", ""), ["area_id"]).count() == 0
    Stub.asked.clear()
    off = providers.ask(centres(spark), f"{stub}/places", None, "")
    assert off.where("answer IS NOT NULL").count() == 0 and not Stub.asked
    assert providers.unanswered(off, ["area_id"], "places unavailable").count() == 3
    assert providers.post("http://127.0.0.1:9/", "{}", {}, 0.5) is None


def test_routes_of_a_provider(spark, stub):
    to = F.array(*[F.struct(F.lit(25.0 + i / 100).alias("lat"), F.lit(121.5).alias("lng")) for i in range(4)])
    asked = spark.createDataFrame([("r",)], "request_id string").withColumn("body", providers.matrix_body((F.lit(25.0), F.lit(121.5)), to))
    routes = providers.matrix_routes(providers.ask(asked, f"{stub}/matrix", "key", providers.MATRIX_FIELDS), ["request_id"])
    assert [(r.slot, r.km, r.minutes) for r in routes.collect()] == [(2, 2.35, 10)]
    rows = spark.createDataFrame([("r", s, 25.0, 121.5, 25.01, 121.5) for s in range(1, 5)], "request_id string, slot int, o_lat double, o_lng double, lat double, lng double")
    got = {r.slot: (r.route_km, r.route_source) for r in serve.with_routes(rows, routes).collect()}
    assert got[2] == (2.35, "live") and got[1][1] == got[3][1] == got[4][1] == "fallback"
    one = providers.single_route(providers.ask(asked, f"{stub}/route", "key", ""), ["request_id"]).first()
    assert (one.km, one.minutes) == (2.0, 1)
    none = providers.single_route(providers.ask(asked, f"{stub}/broken", "key", ""), ["request_id"]).first()
    assert (none.km, none.minutes) == (None, None)


def test_ordered_digest(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None, i / 3) for i in range(500)]
    kind = "n long, t string, x double"
    df = spark.createDataFrame(rows, kind)
    told = lambda df, **more: digests.ordered_digest(df, ["n"], **more).first()
    want = told(df, fan=16)
    assert want.n_rows == 500
    for parts in (1, 3, 9):
        assert told(df.repartition(parts), fan=16, partitions=parts) == want
    swapped = [(rows[4][0], *rows[5][1:]) if i == 4 else (rows[5][0], *rows[4][1:]) if i == 5 else r for i, r in enumerate(rows)]
    assert told(spark.createDataFrame(swapped, kind), fan=16).digest != want.digest
    assert told(spark.createDataFrame(rows[:-1], kind), fan=16).digest != want.digest
    assert told(spark.createDataFrame([*rows[:9], (9, "", 3.0), *rows[10:]], kind)) != told(df)
    assert digests.ordered_digest(df.limit(0), ["n"]).first().digest == hashlib.sha256(b"").hexdigest()
    near = spark.createDataFrame([(1, 25.0123456781)], "n long, lat double"), spark.createDataFrame([(1, 25.0123456784)], "n long, lat double")
    assert told(near[0]) == told(near[1])


def test_demo_evidence(spark):
    areas = spark.createDataFrame([("b", 1.0, 2.0), ("a", 25.0, 121.5)], "area_id string, lat double, lng double")
    probes = spark.createDataFrame([(1, 25.399, 121.999, "density"), (2, 25.395, 121.985, "fallback"), (3, 24.705, 121.995, "fallback")], "seq int, lat double, lng double, assignment string")
    got = {r.request_id: (r.lat, r.assignment, r.period) for r in demo.evidence_points(areas, probes).collect()}
    assert got == {"verified_area": (25.0, "density", "dinner"), "fallback_area": (25.395, "fallback", "dinner")}
    none = {r.request_id: (r.lat, r.assignment) for r in demo.evidence_points(areas, probes.where("seq = 1")).collect()}
    assert none["fallback_area"] == (25.399, "fallback_probe_not_found")
