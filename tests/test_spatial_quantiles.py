"""Joins through cells against all pairs, quantiles by selection against numpy, CSV in
ranges against the csv module."""

import csv
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripforge.operators import evaluate, quantiles, serve, spatial
from tripforge.sources import trips_csv
from tripforge.sources.trips_csv import read_trips


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, x)))


def places(seed, n, spread):
    r = random.Random(seed)
    kinds = {
        "city": lambda: (25 + r.gauss(0, 0.2), 121.5 + r.gauss(0, 0.2)),
        "poles": lambda: (r.choice([-1, 1]) * (90 - abs(r.gauss(0, 0.3))), r.uniform(-180, 180)),
        "dateline": lambda: (r.gauss(0, 0.2), 180 + r.gauss(0, 0.2) if r.random() < 0.5 else -180 + r.gauss(0, 0.2)),
        "world": lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)),
    }
    return [(i, *map(float, kinds[spread]())) for i in range(n)]


SPREADS = ["city", "poles", "dateline", "world"]


@pytest.mark.parametrize("spread", SPREADS)
def test_pairs_within_a_radius(spark, spread):
    points, areas = places(1, 120, spread), places(2, 60, spread)
    p = spark.createDataFrame(points, "id long, lat double, lng double")
    a = spark.createDataFrame(areas, "area_id long, a_lat double, a_lng double")
    for radius in (3.0, 40.0, 3000.0, 30_000.0):
        got = {(r.id, r.area_id) for r in spatial.within(p, a, radius).collect()}
        assert got == {(i, j) for i, x, y in points for j, u, v in areas if km(x, y, u, v) <= radius}, (spread, radius)


@pytest.mark.parametrize("spread", SPREADS)
def test_nearest_with_ties_and_outliers(spark, spread):
    areas = places(3, 40, spread)
    areas += [(100 + i, x, y) for i, x, y in areas[:10]]  # ties
    points = places(4, 60, spread) + [(1000, -33.0, 18.0), (1001, 25.0, 121.5)]
    p = spark.createDataFrame([*points, (2000, None, 1.0)], "id long, lat double, lng double")
    a = spark.createDataFrame([*areas, (7777, None, None)], "area_id long, lat double, lng double")
    got = {r.id: (r.area_id, r.km) for r in spatial.nearest(p, a, "id", start_km=2.0).collect()}
    assert set(got) == {i for i, *_ in points}
    for i, x, y in points:
        d, j = min((round(km(x, y, u, v), 9), j) for j, u, v in areas)
        assert abs(got[i][1] - d) < 1e-6 and abs(km(x, y, *next(z[1:] for z in areas if z[0] == got[i][0])) - d) < 1e-6
        assert got[i][0] < 100 or j >= 100


def test_no_areas_and_no_points(spark):
    none = spark.createDataFrame([], "area_id long, lat double, lng double")
    p = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lat double, lng double")
    assert spatial.nearest(p, none, "id").count() == 0
    assert spatial.nearest(p.where("false"), none.unionByName(p.withColumnRenamed("id", "area_id")), "id").count() == 0


def test_plans_have_no_nested_loops(spark):
    p = spark.createDataFrame([(i, 25.0, 121.5 + i / 1000) for i in range(30)], "request_id long, lat double, lng double")
    a = spark.createDataFrame([(i, 25.0, 121.4 + i / 100) for i in range(30)], "area_id long, lat double, lng double")
    asked = evaluate.candidates(p.withColumn("trip_id", F.col("request_id")), a)
    assert "NestedLoop" not in asked._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in asked._jdf.queryExecution().executedPlan().toString()
    assert serve.nearest_area(p, a, "request_id").count() == 30


def check_quantiles(spark, rows, by, **more):
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(5)
    qs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {tuple(r[c] for c in by): r for r in quantiles.quantiles(df, by, "x", qs, **more).collect()}
    want = {}
    for g, i, x in rows:
        want.setdefault(tuple({"g": g, "i": i}[c] for c in by), []).append(x)
    assert set(got) == set(want)
    for k, v in want.items():
        v = [x for x in v if x is not None]
        assert got[k].n == len(v)
        assert got[k].q == ([None] * len(qs) if not v else pytest.approx(list(np.quantile(v, qs)), rel=1e-12))


def test_quantiles_of_groups(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([1, None]), r.choice([r.gauss(0, 1), 7.0, 1e300 * r.random(), 5.0])) for _ in range(3000)]
    rows += [("one", 1, 3.0), ("two", 1, 3.0), ("two", 1, 4.0), ("none", 2, None), (None, None, 8.0)]
    check_quantiles(spark, rows, ["g", "i"])
    check_quantiles(spark, rows, ["g", "i"], large=0)
    check_quantiles(spark, rows, ["g"], large=500)
    check_quantiles(spark, rows, ["g"], large=0, accuracy=50)
    check_quantiles(spark, rows, [])
    check_quantiles(spark, rows, [], large=0)


def test_brackets_are_narrow(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("g"), (F.xxhash64("id") % 1_000_000).cast("double").alias("x"))
    mine = quantiles.quantiles(rows, ["g"], "x", [0.25, 0.9], large=0).first().q
    theirs = rows.groupBy("g").agg(F.expr("percentile(x, array(0.25D, 0.9D))").alias("q")).first().q
    assert mine == pytest.approx(theirs, rel=1e-12)


# CSV


HEADER = ["a", "b", "c"]


def plain(text):
    rows = csv.reader(io.StringIO(text, newline=""))
    assert next(rows) == HEADER
    return [(n, v) for n, v in enumerate(rows, 2) if v]


def check_csv(spark, folder, text, chunk, name="x.csv"):
    path = folder / name
    path.write_bytes(text.encode("utf-8"))
    got = sorted((r.row_number, r.vals) for r in read_trips(spark, str(path), HEADER, chunk).collect())
    assert got == plain(text.removeprefix("﻿"))


def test_records_that_span_chunks(spark, tmp_path):
    r = random.Random(6)
    bits = ['"', '""', ",", "\n", "\r\n", "\r", "x", "ä", " ", '"a\nb"', '"q"",\n"', "\n\n", "1,2,3\n", '"u,v",w,"z\r\n"\n']
    for k in range(12):
        text = "a,b,c\n" + "".join(r.choice(bits) for _ in range(r.randint(0, 120))) + "\n"
        check_csv(spark, tmp_path, ("﻿" if k % 2 else "") + text, r.choice([1, 5, 40, 1 << 20]), f"{k}.csv")


def test_a_record_over_many_chunks(spark, tmp_path):
    check_csv(spark, tmp_path, 'a,b,c\n1,"' + "line\n" * 50 + '",3\n\n4,5,6\n"' + "open\n" * 20, 7)


def test_many_ranges_and_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = "a,b,c\n" + "".join(f'{i},"x{i}\n\ny",z\n' + "\n" * (i % 3 == 0) for i in range(3000))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        for n in range(3):
            (tmp_path / f"f{n}.csv").write_bytes(text.encode())
        (tmp_path / "other.txt").write_text("not read")
        got = read_trips(spark, str(tmp_path), HEADER, 1000)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = plain(text)
    for n in range(3):
        assert sorted((r.row_number, r.vals) for r in rows if r.path.endswith(f"f{n}.csv")) == want
    assert len(rows) == 3 * len(want)


def test_headers(spark, tmp_path):
    for k, text in enumerate(["", "a,b\n1,2\n", "\na,b,c\n", '"a\n",b,c\n']):
        (tmp_path / f"{k}.csv").write_text(text)
        with pytest.raises(Exception, match="header|contract"):
            read_trips(spark, str(tmp_path / f"{k}.csv"), HEADER, 3).count()
    (tmp_path / "ok.csv").write_text('"a",b,"c"')
    assert read_trips(spark, str(tmp_path / "ok.csv"), HEADER).count() == 0


def test_both_readings_of_a_chunk():
    assert trips_csv.outcome("x\ny\n", False) == (False, 2) and trips_csv.outcome("x\ny\n", True) == (True, 0)
    assert trips_csv.outcome('a"b\n', False) == (False, 1) and trips_csv.outcome('a"b\n', True) == (False, 1)
    assert trips_csv.outcome('"\n', False) == (True, 0) and trips_csv.outcome('"\n', True) == (False, 1)
    assert trips_csv.outcome('""\n', True) == (True, 0) and trips_csv.outcome("a\rb\r\n", False) == (False, 2)
