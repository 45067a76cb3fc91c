import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from tripforge.functions import geo, scoring
from tripforge.functions.calendar import period_of_hour, serving_period_of_hour, split_of, weekday_class


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


def test_one_degree_is_111_km(spark):
    assert value(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111.195, abs=1e-3)
    assert value(spark, geo.road_distance_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(1.3 * 111.195, abs=1e-2)


@pytest.mark.parametrize("lat,lng,region", [(25.05, 121.5, "Taipei"), (24.7, 121.2, "Taipei"), (24.69, 121.3, "Taichung"), (23.8, 120.2, "Taichung"), (23.79, 120.2, "Kaohsiung"), (23.0, 121.2, "Other/Unknown"), (0.0, 0.0, "Other/Unknown")])
def test_regions_have_mixed_edges(spark, lat, lng, region):
    assert value(spark, geo.region_bucket(lit(lat), lit(lng))) == region


def test_periods(spark):
    rows = spark.range(24).select("id", period_of_hour(F.col("id")).alias("p"), serving_period_of_hour(F.col("id")).alias("s")).collect()
    want = lambda h: "morning" if 5 <= h <= 10 else "lunch" if 11 <= h <= 13 else "afternoon" if 14 <= h <= 16 else "dinner" if 17 <= h <= 20 else "night"
    assert all(r.p == want(r.id) for r in rows)
    assert all(r.s == ("morning" if r.id < 11 else want(r.id)) for r in rows)


def test_splits_and_weekdays(spark):
    at = lambda s: F.to_timestamp(lit(s))
    assert value(spark, split_of(at("2026-03-15 23:59:59"))) == "train"
    assert value(spark, split_of(at("2026-03-16 00:00:00"))) == "validation"
    assert value(spark, split_of(at("2026-04-01 00:00:00"))) == "test"
    assert value(spark, weekday_class(at("2026-03-13 12:00:00"))) == "weekday"
    assert value(spark, weekday_class(at("2026-03-14 12:00:00"))) == "weekend"


def test_rider_key_is_hmac(spark):
    want = "rider_" + hmac.new(b"pepper", b"4711", hashlib.sha256).hexdigest()
    assert value(spark, scoring.rider_key(lit(4711), "pepper")) == want
    long = "x" * 100
    assert value(spark, scoring.rider_key(lit(1), long)) == "rider_" + hmac.new(long.encode(), b"1", hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        scoring.rider_key(lit(1), "")


@pytest.mark.parametrize("d,want", [(1.0, 0.35 + 0.65 / 2), (2.0, 1.0), (5.0, 1.0), (7.5, 1.0 - 0.35 * 0.5), (20.0, 0.65 * math.exp(-1.0))])
def test_distance_fit(spark, d, want):
    for form in (scoring.distance_fit, scoring.distance_fit_batch, scoring.distance_fit_serving):
        assert value(spark, form(lit(d), lit(2.0), lit(5.0), lit(10.0))) == pytest.approx(want)


def test_distance_fit_variants_differ_at_zero_percentiles(spark):
    args = [lit(0.05), lit(0.0), lit(0.0), lit(0.0)]
    assert value(spark, scoring.distance_fit(*args)) == pytest.approx(0.35 + 0.65 * 0.5)
    assert value(spark, scoring.distance_fit_serving(*args)) == pytest.approx(0.65 * math.exp(-5.0))


def test_budget_and_proximity(spark):
    none = lit(None).cast("string")
    assert value(spark, scoring.distance_budget_km(none, lit(3.0))) == 8.0
    assert value(spark, scoring.distance_budget_km(lit("full"), lit(1.0))) == 6.0
    assert value(spark, scoring.distance_budget_km(lit("full"), lit(20.0))) == 10.0
    assert value(spark, scoring.distance_budget_km(lit("light"), lit(5.0))) == 7.5
    assert value(spark, scoring.proximity_fit(lit(3.0), lit(8.0))) == 1.0
    assert value(spark, scoring.proximity_fit(lit(8.0), lit(8.0))) == 0.15
    assert value(spark, scoring.proximity_fit(lit(5.5), lit(8.0))) == 0.5


def test_missing_components_are_reweighted(spark):
    none = lit(None).cast("double")
    assert value(spark, scoring.poi_quality(lit(4.5), lit(None).cast("int"), lit(100))) == 0.9
    assert value(spark, scoring.poi_quality(none, lit(None).cast("int"), lit(100))) is None
    assert value(spark, scoring.restaurant_score(lit(0.9), none, lit(0.7))) == pytest.approx(0.85)
    assert value(spark, scoring.clip(none)) is None


def test_robust_scaling(spark):
    assert value(spark, scoring.robust_minmax(lit(5.0), lit(0.0), lit(10.0))) == 0.5
    assert value(spark, scoring.robust_minmax(lit(5.0), lit(3.0), lit(3.0))) == 0.0
    assert value(spark, scoring.robust_minmax(lit(50.0), lit(0.0), lit(10.0))) == 1.0


@pytest.mark.parametrize("km,want", [(0.0, "0-2"), (2.0, "2-5"), (4.999, "2-5"), (5.0, "5-10"), (10.0, "10+")])
def test_distance_bins(spark, km, want):
    assert value(spark, scoring.distance_bin(lit(km))) == want


def test_levels(spark):
    assert [value(spark, scoring.personalization_level(lit(n))) for n in (2, 3, 9, 10)] == ["cold", "light", "light", "full"]
