import csv
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tripforge.operators import clean
from tripforge.sources.trips_csv import audit, read_trips

ZONE = timezone(timedelta(hours=8))


@pytest.fixture(autouse=True)
def taipei(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def record(i, **change):
    start = datetime(2026, 2, 1, 8, tzinfo=ZONE) + timedelta(minutes=7 * i)
    row = dict(zip(clean.SOURCE_FIELDS, [
        str(900000000 + i), str(800000000 + i % 37), start.isoformat(), (start + timedelta(minutes=12 + i % 9)).isoformat(), f"{25.01 + i % 10 / 1000:.6f}", f"{121.5 + i % 10 / 1000:.6f}",
        f"{25.03 + i % 13 / 1000:.6f}", f"{121.52 + i % 13 / 1000:.6f}", str(12 + i % 9), str(3000 + i % 17 * 250), (start - timedelta(minutes=8)).isoformat(), "station" if i % 3 == 0 else "", "", "[100,200]" if i % 2 else "[200,300]",
    ]))
    return list((row | change).values())


def run(spark, tmp_path, rows, blank_after=None):
    path = tmp_path / "trips.csv"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(clean.SOURCE_FIELDS)
        for i, r in enumerate(rows):
            w.writerow(r)
            if i == blank_after:
                f.write("\r\n")
    return clean.classified(read_trips(spark, str(path), clean.SOURCE_FIELDS))


def hard(rows):
    return {r.row_number: r.hard for r in rows.collect()}


def test_valid_rows_are_clean(spark, tmp_path):
    rows = run(spark, tmp_path, [record(i) for i in range(1000)])
    trips = clean.clean(rows)
    assert trips.count() == 1000 and clean.quarantine(rows).count() == 0
    first = trips.where("trip_id = 900000001").first()
    assert (first.fare_lower_exclusive, first.fare_upper_inclusive, first.fare_midpoint) == (101.0, 200.0, 150.5)
    assert first.period == "morning" and first.split == "train" and first.pickup_region == "Taipei" and first.started_date == "2026-02-01"
    assert len(trips.columns) == 27 and first.dropoff_poi_text is None


def test_hard_rules(spark, tmp_path):
    rows = [record(0), record(1, PickUpLatitude="28.0"), record(0), record(3)[:13], record(4) + ["more"], record(5, PaymentTotalRange="[200,100]"), record(6, PickUpLatitude="inf"), record(7, PickUpLatitude="nan"),
            record(8, TravelTime="0"), record(9, TravelDistance="-1"), record(10, OrderStartDateTime_UTC8="2026-02"), record(11, Id="x", RiderId="y"), record(12, TravelTime="-3"), record(12)]
    rows[2][13] = "bad"
    got = hard(run(spark, tmp_path, rows, blank_after=0))
    # record numbers start at 2; the blank record after the first counts
    assert got[2] == [] and got[4] == ["coordinate_out_of_range"]
    assert got[5] == ["fare_parse", "duplicate_trip_id"]
    assert got[6] == ["column_count"] and got[7] == ["column_count"]
    assert got[8] == ["fare_parse"] and got[9] == ["coordinate_parse"] and got[10] == ["coordinate_parse"]
    assert got[11] == ["travel_time_nonpositive"] and got[12] == ["travel_distance_parse"] and got[13] == ["datetime_parse"]
    assert got[14] == ["required_field_parse"]
    assert got[15] == ["travel_time_parse"] and got[16] == ["duplicate_trip_id"]


def test_times(spark, tmp_path):
    rows = [record(0, OrderEndDateTime_UTC8="2026-02-01 07:00:00"), record(1, OrderFormCreatedTime_UTC8="2026-02-01T09:00:00Z"), record(2, OrderStartDateTime_UTC8="08:00")]
    got = hard(run(spark, tmp_path, rows))
    assert got == {2: ["ended_before_started"], 3: ["ordered_after_started"], 4: ["datetime_parse"]}


def test_soft_rules_in_order(spark, tmp_path):
    trips = clean.clean(run(spark, tmp_path, [record(0, TravelDistance="0", TravelTime="1"), record(1)]))
    got = {r.trip_id: r for r in trips.collect()}
    assert got[900000000].exclusion_reasons == "distance_zero;speed_low;elapsed_time_mismatch" and not got[900000000].model_eligible
    assert got[900000001].exclusion_reasons == "" and got[900000001].model_eligible


def test_quality_reconciles(spark, tmp_path):
    rows = run(spark, tmp_path, [record(0), record(1, PickUpLatitude="28.0"), record(0), record(3)[:5]])
    report = {(r.metric, r.key): r.n for r in clean.quality(rows, clean.clean(rows)).collect()}
    assert report["rows", "clean"] == 1 and report["rows", "quarantine"] == 3
    assert report["hard_rule", "duplicate_trip_id"] == 1 and report["split", "train"] == 1
    bad = clean.quarantine(rows).where("quarantine_reasons = 'column_count'").first()
    assert bad.Id == "900000003" and bad.PaymentTotalRange is None
    a = audit(rows, len(clean.SOURCE_FIELDS)).first()
    assert (a.rows, a.wrong_width, a.rejected) == (4, 1, 0)


def test_header_contract(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="contract"):
        read_trips(spark, str(path), clean.SOURCE_FIELDS).count()


@pytest.mark.parametrize("text,want", [(" 12 ", 12), ("+3", 3), ("1_000", 1000), ("1.5", None), ("", None), (None, None)])
def test_integers(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(clean.parse_int(F.col("x")).alias("y")).first().y == want


def test_rows_without_a_key_are_no_duplicates(spark):
    rows = spark.createDataFrame([(None, "f", 1), (None, "f", 2), (5, "g", 2), (5, "f", 9), (5, "g", 1)], "trip_id long, path string, row_number long")
    got = {(r.path, r.row_number): r.duplicate for r in clean.flag_duplicates(rows, order=("path", "row_number")).collect()}
    assert got == {("f", 1): False, ("f", 2): False, ("f", 9): False, ("g", 1): True, ("g", 2): True}
