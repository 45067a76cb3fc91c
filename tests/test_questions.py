"""Questions with their candidates as arrays, against the rules by rows of `evaluate`."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripforge.operators import evaluate, questions
from tripforge.plans import testbed
from tripforge.sources.scratch import stored

PERIODS = ("morning", "lunch", "afternoon", "dinner", "night")
BY = ["level", "period", "weekday_class"]


def world(spark, seed=1, n=300):
    """Areas of three far places (one with few areas), riders of all levels, some with B."""
    r = np.random.default_rng(seed)
    areas = [(f"a{i:02}", 25.0 + (5 if i >= 14 else 0) + r.random() * 0.3, 121.0 + r.random() * 0.3) for i in range(17)]
    names = [a[0] for a in areas]
    ctx = [(p, w) for p in PERIODS for w in ("weekday", "weekend")]
    pick = lambda x: x[r.integers(len(x))]
    qs = [(i, int(r.integers(40)), *pick(ctx), pick([*names, None]), pick([*names, None]), 25.0 + (5 if r.random() < 0.2 else 0) + r.random() * 0.3, 121.0 + r.random() * 0.3) for i in range(n)]
    qs += [(n, 1, "night", "weekday", "a01", "a01", None, 121.0), (n + 1, 1, "night", "weekday", "a01", "a01", -60.0, 0.0)]
    profiles = [(k, int(3 * k + 1), "cold" if k < 1 else "light" if k < 4 else "full", *[float(x) for x in np.sort(r.random(4) * 9)], *[float(x) for x in r.random(6)]) for k in range(30)]
    t = {
        "areas": (areas, "area_id string, lat double, lng double"),
        "questions": (qs, "trip_id long, rider_id long, period string, weekday_class string, origin_id string, actual string, lat double, lng double"),
        "global": ([(p, w, a, int(r.integers(1, 9))) for p, w in ctx for a in names if r.random() < 0.7], "period string, weekday_class string, candidate string, g long"),
        "origin": ([(o, p, w, a, int(r.integers(1, 4))) for o in names[:9] for p, w in ctx for a in names if r.random() < 0.3], "origin_id string, period string, weekday_class string, candidate string, o long"),
        "scored": ([(a, p, w, round(float(r.random()), 1)) for a in names for p, w in ctx[:9]], "candidate string, period string, weekday_class string, a_score double"),
        "profiles": (profiles, "rider_id long, trip_count long, level string, p25_km double, median_km double, p75_km double, p90_km double, weekend_ratio double, " + ", ".join(f"{p}_ratio double" for p in PERIODS)),
        "visits": ([(k, a, int(r.integers(1, 5))) for k in range(30) for a in names if r.random() < 0.2], "rider_id long, area_id string, visits long"),
        "cohorts": ([("light", 1.0, 3.0, 6.0)], "level string, p25 double, p75 double, p90 double"),
        "zero": ([(k, 0.05) for k in range(20)], "rider_id long, b_zero double"),
        "seen": ([(k, p, a, round(float(r.random()), 1)) for k in range(20) for p in PERIODS for a in names if r.random() < 0.3], "rider_id long, period string, area_id string, b_score double"),
    }
    return {k: spark.createDataFrame(*v) for k, v in t.items()}


def by_rows(w):
    rows = evaluate.candidates(w["questions"], w["areas"]).join(w["global"], ["period", "weekday_class", "candidate"], "left").join(w["origin"], ["origin_id", "period", "weekday_class", "candidate"], "left")
    rows = rows.join(w["origin"].select("origin_id", "period", "weekday_class", F.lit(True).alias("has")).distinct(), ["origin_id", "period", "weekday_class"], "left")
    g = F.coalesce("g", F.lit(0))
    rows = rows.withColumn("global_score", g).withColumn("origin_score", F.when(F.col("has"), F.coalesce("o", F.lit(0))).otherwise(g)).drop("g", "o", "has").join(w["scored"], ["candidate", "period", "weekday_class"])
    rows = evaluate.c_scores(rows, w["profiles"], w["visits"], w["cohorts"]).join(w["zero"], "rider_id", "left")
    rows = rows.join(w["seen"].withColumnRenamed("area_id", "candidate"), ["rider_id", "period", "candidate"], "left").withColumn("b_score", F.coalesce("b_score", "b_zero"))
    return rows.join(w["profiles"].select("rider_id", "level"), "rider_id", "left").withColumn("level", F.coalesce("level", F.lit("cold")))


def by_questions(w):
    terms = evaluate.rider_terms(w["profiles"], w["visits"], w["cohorts"])
    return questions.asked(w["questions"], w["areas"], w["global"], w["origin"], w["scored"], terms, w["visits"], w["zero"], w["seen"])


def told(df, *keys):
    return {tuple(r[k] for k in keys): tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


@pytest.mark.parametrize("cells", [1 << 17, 50])
def test_as_by_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(questions, "CELLS", cells)
    w = world(spark)
    rows, asked = stored(by_rows(w)), stored(by_questions(w))
    want = evaluate.summary(evaluate.outcomes_of_scores(rows, evaluate.DEFAULT_WEIGHTS, BY, 9), 17, BY)
    got = evaluate.summary_of_sums(*questions.outcome_sums(asked, evaluate.DEFAULT_WEIGHTS, BY, 9), 17, BY)
    assert told(got, "model", "grouping", "value") == told(want, "model", "grouping", "value")
    for strict in (False, True):
        assert told(questions.tune(asked, strict), "model", "weights") == told(evaluate.tune(rows, strict, digits=9), "model", "weights")


def test_a_question_stays_a_row(spark):
    """No row for each candidate leaves a question before the sums."""
    w = world(spark)
    assert by_questions(w).count() <= w["questions"].count()


def test_whole_ids_far_apart_and_none():
    import pyarrow as pa

    a, b = questions._codes(pa.array([5, None, 1 << 40]), pa.array([1 << 40, 7]))
    assert a.tolist() == [0, -1, 2] and b.tolist() == [2, 1]


def test_stored_leaves_no_shuffle_files(spark, tmp_path):
    """What a stored table shuffled takes no disk afterwards."""
    before = set(_shuffles(spark))
    stored(spark.range(50_000).repartition(7, "id"))
    assert set(_shuffles(spark)) <= before


def _shuffles(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return [f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")]


@pytest.mark.parametrize("odd", [False, True])
def test_ids_of_two_orders(spark, tmp_path, odd):
    """Line 9 of order 1 has the id of line 1 of order 2; else no id needs a shuffle of its own."""
    import datetime

    day = datetime.datetime(2026, 1, 1)
    lines = [(1, 5, 5, 9 if odd else 1, 3.0, 1.0, day), (2, 6, 6, 1, 3.0, 1.0, day), (2, 4, 6, 1, 3.0, 1.0, day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    t = testbed.trips(spark, str(tmp_path))
    assert t.where("duplicate").count() == (2 if odd else 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = testbed.trips(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == (3 if odd else 2)
