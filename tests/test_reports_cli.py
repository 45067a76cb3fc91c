"""Reports, records of areas, both ends of trips, and the commands."""

import csv
import json

import numpy as np
from test_clean import record

from tripforge import __main__ as cli, config
from tripforge.operators import clean, density, reports, serve


def test_output_folders(tmp_path, monkeypatch):
    monkeypatch.delenv("PROCESSED_DATA_DIR", raising=False)
    assert config.choose_output(tmp_path, "PROCESSED_DATA_DIR") == (tmp_path / "data/processed").resolve()
    (tmp_path / ".env").write_text("PROCESSED_DATA_DIR=here\n")
    assert config.choose_output(tmp_path, "PROCESSED_DATA_DIR") == (tmp_path / "here").resolve()
    monkeypatch.setenv("PROCESSED_DATA_DIR", "/abs")
    assert str(config.choose_output(tmp_path, "PROCESSED_DATA_DIR")) == "/abs"
    assert config.choose_output(tmp_path, "PROCESSED_DATA_DIR", "given") == (tmp_path / "given").resolve()


def test_manifests_name_versions_and_files(tmp_path):
    (tmp_path / "x").write_text("1")
    m = config.manifest([tmp_path / "x"], {}, {}, [tmp_path / "x"])
    assert set(m["versions"]) == {"python", "platform", "pyspark"} and list(m["artifacts"].values()) == list(m["inputs"].values())
    config.write_json(tmp_path / "m.json", m | {"versions": {"python": "1"}})
    assert config.matches(tmp_path / "m.json", m) and config.read_json(tmp_path / "m.json")["inputs"] == m["inputs"]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda zone: spark)
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("RAW_DATA_PATH", raising=False)
    assert cli.main(["audit"]) == 2
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert cli.main(["audit", "--input", "bad.csv"]) == 1
    with open(tmp_path / "trips.csv", "w", newline="") as f:
        csv.writer(f).writerows([clean.SOURCE_FIELDS, *[record(i) for i in range(20)]])
    assert cli.main(["audit", "--input", "trips.csv"]) == 0
    assert cli.main(["clean", "--input", "trips.csv", "--output", "out"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/trips_clean")).count() == 20
    report = json.loads((tmp_path / "out/quality_report.json").read_text())
    assert {"metric": "rows", "key": "clean", "n": 20} in report and "| clean | 20 |" in (tmp_path / "out/quality_report.md").read_text()
    assert len(json.loads((tmp_path / "out/manifest.json").read_text())["artifacts"]) == 2


def test_latency():
    times = iter(range(100))
    p50, p95 = cli.latency(lambda: next(times), 20)
    assert 0 <= p50 <= p95


def test_records_of_areas(spark):
    ranked = spark.createDataFrame([("r", 1, "a", 2.5, 0.7, 0.6)], "request_id string, rank int, area_id string, distance_km double, score double, base_score double")
    areas = spark.createDataFrame([("a", 25.0, 121.5, 0.4)], "area_id string, lat double, lng double, radius_p90_km double")
    got = serve.area_records(ranked, areas).first().asDict(True)
    parts = {"area_attraction": None, "personal_mobility": None, "base_model_score": 0.6, "proximity_fit": None}
    assert got == {"request_id": "r", "rank": 1, "area": {"area_id": "a", "centroid": {"latitude": 25.0, "longitude": 121.5}, "radius_km": 0.4, "distance_km": 2.5, "score": 0.7, "score_breakdown": parts}}


def test_both_ends_of_trips(spark):
    r = np.random.default_rng(1)
    at = np.concatenate([r.normal((25.03, 121.5), 0.002, (60, 2)), r.normal((25.1, 121.6), 0.002, (60, 2))])
    c = density.fit(np.radians(at), 20, 5)
    trips = spark.createDataFrame([(1, 25.03, 121.5, 24.0, 120.5), (2, 0.0, 0.0, 25.1, 121.6)], "trip_id long, pickup_lat double, pickup_lng double, dropoff_lat double, dropoff_lng double")
    got = {x.trip_id: (x.pickup_assignment, x.pickup_region, x.dropoff_assignment, x.dropoff_area_id) for x in density.assign_trips(trips, c, 5).collect()}
    assert got[1] == ("density", "Taipei", "fallback", "area-fallback-taichung") and got[2][0] == "fallback" and got[2][2] == "density"


def test_markdown(spark):
    grid = spark.createDataFrame([("all", 10, 5, 2, "ok", 3, 0.25, 1.0, 2.0, 0.1, 0.2, {"Taipei": 0.5}, None), ("all", 20, 5, 2, "skipped", *[None] * 7, "sample exceeds the pool")], density.GRID)
    text = reports.cluster_report(grid)
    assert "| all | 10 | 5 | 2 | 3 | 0.2500 | 0.2000 | 0.5000 | ok |" in text and "1 of 2 candidates" in text and "- all 20/5/2: sample exceeds the pool" in text
    side = lambda h: spark.createDataFrame([("area_a", "overall", 9, h, 0.5), ("area_a", "period", 9, 0.1, 0.1)], "model string, grouping string, questions long, hit5 double, mrr5 double")
    text = reports.evaluation_report({"selected_model": "area_a"}, side(0.25), side(0.5), ["one city"])
    assert "- selected model: area_a" in text and "| area_a | 0.2500 | 0.5000 | 0.5000 | 0.5000 |" in text and "- one city" in text
