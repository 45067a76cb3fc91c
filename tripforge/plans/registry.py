"""The engine's own queries on the derived trip view, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.operators import areas as area_ops, attraction, clean, demo, evaluate, fares, questions, riders, serve
from tripforge.plans.testbed import SQL, areas, eligible, is_eligible, trips
from tripforge.sources.scratch import stored, stored_all

QUERIES: dict = {}
ORACLES: dict = {}


#: For scores by neighbours, riders are taken together: the view's own riders have next to
#: no second visit to an area, which leaves their scale without a range.
GROUPS = 211


def query(sql: str | None = None, view: bool = True, grouped: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            base = SQL.replace("o_custkey * 7 + n AS rider_id", f"(o_custkey * 7 + n) % {GROUPS} AS rider_id") if grouped else SQL
            ORACLES[f.__name__] = (base if view else "") + sql
        return f

    return add


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(trips(spark, sf_dir)).where("split = 'train'")


def grouped_riders(t: DataFrame) -> DataFrame:
    return t.withColumn("rider_id", F.col("rider_id") % GROUPS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CUBE = """, binned AS (SELECT CASE WHEN distance_km < 2 THEN '0-2' WHEN distance_km < 5 THEN '2-5' WHEN distance_km < 10 THEN '5-10' ELSE '10+' END AS distance_bin, period, pickup_region AS region, fare_midpoint FROM ok WHERE split = 'train'),
cube AS (SELECT distance_bin, CASE WHEN grouping(period) = 1 THEN 'all_periods' ELSE period END AS period, CASE WHEN grouping(region) = 1 THEN 'all_regions' ELSE region END AS region, count(*) AS sample_count,
  round(quantile_cont(fare_midpoint, 0.25), 2) AS fare_p25, round(quantile_cont(fare_midpoint, 0.75), 2) AS fare_p75
  FROM binned GROUP BY GROUPING SETS ((distance_bin, period, region), (distance_bin, period), (distance_bin, region), (distance_bin)) HAVING count(*) >= 30)
"""


@query(CUBE + "SELECT * FROM cube")
def fare_cube(spark, sf_dir):
    return fares.fare_cube(train(spark, sf_dir))


@query(CUBE + """, req AS (SELECT trip_id AS request_id, CASE WHEN distance_km < 2 THEN '0-2' WHEN distance_km < 5 THEN '2-5' WHEN distance_km < 10 THEN '5-10' ELSE '10+' END AS distance_bin, period, pickup_region AS region FROM ok WHERE split = 'test'),
rungs AS (SELECT request_id, distance_bin, 0 AS rung, 'distance_period_region' AS source, period, region FROM req
  UNION ALL SELECT request_id, distance_bin, 1, 'distance_period_all_regions', period, 'all_regions' FROM req
  UNION ALL SELECT request_id, distance_bin, 2, 'distance_all_periods_region', 'all_periods', region FROM req
  UNION ALL SELECT request_id, distance_bin, 3, 'distance_only', 'all_periods', 'all_regions' FROM req),
hit AS (SELECT request_id, source, fare_p25, fare_p75, sample_count, row_number() OVER (PARTITION BY request_id ORDER BY rung) AS k FROM rungs JOIN cube USING (distance_bin, period, region))
SELECT request_id, distance_bin, source, fare_p25, fare_p75, sample_count FROM req LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (request_id)""")
def fare_ladder(spark, sf_dir):
    t = stored(eligible(trips(spark, sf_dir)).where("split <> 'validation'").select("trip_id", "distance_km", "period", "pickup_region", "fare_midpoint", "split"), "trips")
    requests = t.where("split = 'test'").select(F.col("trip_id").alias("request_id"), "distance_km", "period", F.col("pickup_region").alias("region"))
    return fares.fare_ladder(requests, fares.fare_cube(t.where("split = 'train'")))


@query("SELECT trip_id, count(*) AS n_rows, count(*) FILTER (duplicate) AS n_duplicates FROM trips GROUP BY trip_id")
def dup_flag(spark, sf_dir):
    return trips(spark, sf_dir).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("duplicate").alias("n_duplicates"))


SOFT = """, soft AS (SELECT pickup_region, day, unnest(list_filter([
  CASE WHEN travel_distance_m = 0 THEN 'distance_zero' END,
  CASE WHEN travel_time_min > 0 AND distance_km / (travel_time_min / 60::DOUBLE) < 1 THEN 'speed_low' END,
  CASE WHEN travel_time_min > 0 AND distance_km / (travel_time_min / 60::DOUBLE) > 120 THEN 'speed_high' END,
  CASE WHEN travel_time_min > 180 THEN 'travel_time_long' END, CASE WHEN travel_distance_m > 200000 THEN 'distance_long' END,
  CASE WHEN jitter > 2 THEN 'elapsed_time_mismatch' END], lambda x: x IS NOT NULL)) AS rule FROM trips WHERE NOT duplicate)
"""


def _soft(spark, sf_dir):
    t = trips(spark, sf_dir).where("not duplicate").withColumn("elapsed", (F.col("travel_time_min") + F.col("jitter")).cast("double"))
    speed = clean.speed_kph(F.col("distance_km"), F.col("travel_time_min"))
    reasons = clean.soft_reasons(F.col("distance_km"), F.col("travel_time_min"), F.col("travel_distance_m"), F.col("elapsed"), speed)
    return t.select("pickup_region", "day", F.explode(reasons).alias("rule"))


@query(SOFT + "SELECT rule, count(*) AS n FROM soft GROUP BY rule")
def clean_soft_rules(spark, sf_dir):
    return _soft(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(SOFT + "SELECT pickup_region, day, rule, count(*) AS n FROM soft GROUP BY ALL")
def soft_by_region(spark, sf_dir):
    return _soft(spark, sf_dir).groupBy("pickup_region", "day", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, count(*) AS n_rows, count(*) FILTER (duplicate) AS n_duplicates, (SELECT count(*) FROM ok WHERE ok.split = trips.split) AS n_eligible FROM trips GROUP BY split")
def split_counts(spark, sf_dir):
    t = trips(spark, sf_dir)
    ok = eligible(t).groupBy("split").agg(F.count(F.lit(1)).alias("n_eligible"))
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("duplicate").alias("n_duplicates")).join(ok, "split", "left")


@query("SELECT area_id, period, weekday_class, count(*) AS visits, count(DISTINCT day) AS days FROM ok WHERE split = 'train' GROUP BY ALL")
def area_context_counts(spark, sf_dir):
    return attraction.context_counts(train(spark, sf_dir))


ENTROPY = """, src AS (SELECT area_id, origin_id, count(*) AS n FROM ok WHERE split = 'train' GROUP BY ALL),
tot AS (SELECT area_id, sum(n) AS known, sum(CASE WHEN origin_id <> area_id THEN n ELSE 0 END) AS crossing, count(*) AS k FROM src GROUP BY area_id),
ent AS (SELECT area_id, known, crossing::DOUBLE / known AS cross_area_ratio, CASE WHEN k > 1 THEN -sum(n::DOUBLE / known * ln(n::DOUBLE / known)) / ln(k) ELSE 0 END AS source_diversity FROM src JOIN tot USING (area_id) GROUP BY area_id, known, crossing, k)
"""


@query(ENTROPY + "SELECT area_id, known::BIGINT AS known, round(cross_area_ratio, 6) AS cross_area_ratio, round(source_diversity, 6) AS source_diversity FROM ent")
def source_entropy(spark, sf_dir):
    return rounded(attraction.source_entropy(train(spark, sf_dir)))


RETURN = """, vis AS (SELECT area_id, rider_id, count(*) AS n FROM ok WHERE split = 'train' GROUP BY ALL),
ret AS (SELECT area_id, count(*) AS riders, count(*) FILTER (n >= 2) AS repeaters, (count(*) FILTER (n >= 2))::DOUBLE / count(*) AS return_rate FROM vis GROUP BY area_id)
"""


@query(RETURN + "SELECT area_id, riders, repeaters, round(return_rate, 6) AS return_rate FROM ret")
def return_rate(spark, sf_dir):
    return rounded(attraction.return_rate(train(spark, sf_dir)))


ATTRACTION = ENTROPY + RETURN + """, ctx AS (SELECT * FROM (SELECT unnest(['morning', 'lunch', 'afternoon', 'dinner', 'night']) AS period), (SELECT unnest(['weekday', 'weekend']) AS weekday_class)),
cnt AS (SELECT area_id, period, weekday_class, count(*) AS visits, count(DISTINCT day) AS days FROM ok WHERE split = 'train' GROUP BY ALL),
ct AS (SELECT period, weekday_class, count(*) AS total FROM ok WHERE split = 'train' GROUP BY ALL),
at_ AS (SELECT area_id, count(*) AS total FROM ok WHERE split = 'train' GROUP BY ALL),
al AS (SELECT count(DISTINCT day) AS days, count(*) AS total FROM ok WHERE split = 'train'),
grid AS (SELECT areas.area_id, ctx.period, ctx.weekday_class, coalesce(visits, 0) AS visits, coalesce(cnt.days, 0) AS days, coalesce(riders, 0) AS riders, coalesce(repeaters, 0) AS repeaters,
  ln(1 + coalesce(visits, 0)::DOUBLE / al.days) AS visit_heat,
  ln(((coalesce(visits, 0) + 1)::DOUBLE / (coalesce(ct.total, 0) + 36)) / ((coalesce(at_.total, 0) + 1)::DOUBLE / (al.total + 36))) AS period_lift,
  coalesce(cross_area_ratio, 0) AS cross_area_ratio, coalesce(source_diversity, 0) AS source_diversity, coalesce(return_rate, 0) AS return_rate
  FROM areas CROSS JOIN ctx CROSS JOIN al LEFT JOIN cnt USING (area_id, period, weekday_class) LEFT JOIN ct USING (period, weekday_class) LEFT JOIN at_ USING (area_id) LEFT JOIN ent USING (area_id) LEFT JOIN ret USING (area_id)),
""" + "lim AS (SELECT " + ", ".join(f"quantile_cont({m}, 0.05) AS {m}_lo, quantile_cont({m}, 0.95) AS {m}_hi" for m in attraction.A_WEIGHTS) + " FROM grid),\nsc AS (SELECT area_id, period, weekday_class, visits, days, riders, repeaters, " + ", ".join(
    f"CASE WHEN abs({m}_hi - {m}_lo) <= 1e-12 THEN 0 ELSE greatest(0, least(1, ({m} - {m}_lo) / ({m}_hi - {m}_lo))) END AS {m}" for m in attraction.A_WEIGHTS
) + " FROM grid CROSS JOIN lim),\nattr AS (SELECT *, " + " + ".join(f"{w} * {m}" for m, w in attraction.A_WEIGHTS.items()) + " AS area_score FROM sc)\n"


def _scored(t, spark):
    t = stored(t.select("area_id", "origin_id", "rider_id", "day", "period", "weekday_class"), "trips")
    return attraction.area_attraction(stored(attraction.area_grid(t, areas(spark)), "grid"))


@query(ATTRACTION + "SELECT area_id, period, weekday_class, visits, days, riders, repeaters, round(area_score, 6) AS area_score, " + ", ".join(f"round({m}, 6) AS {m}" for m in attraction.A_WEIGHTS) + " FROM attr")
def area_attraction(spark, sf_dir):
    return rounded(_scored(train(spark, sf_dir), spark))


@query(ATTRACTION + "SELECT * FROM (SELECT period, weekday_class, area_id, round(area_score, 6) AS area_score, row_number() OVER (PARTITION BY period, weekday_class ORDER BY round(area_score, 9) DESC, visits DESC, area_id) AS rank FROM attr) WHERE rank <= 10")
def area_rank(spark, sf_dir):
    scored = _scored(train(spark, sf_dir), spark).withColumn("area_score", F.round("area_score", 9))
    return rounded(attraction.rank_areas(scored, ["period", "weekday_class"]).select("period", "weekday_class", "area_id", "area_score", "rank"))


@query("SELECT origin_id, period, weekday_class, area_id, count(*) AS n, row_number() OVER (PARTITION BY origin_id, period, weekday_class ORDER BY count(*) DESC, area_id) AS rank FROM ok WHERE split = 'train' GROUP BY origin_id, period, weekday_class, area_id")
def origin_popularity(spark, sf_dir):
    return attraction.popularity(train(spark, sf_dir), ["origin_id", "period", "weekday_class"])


@query("SELECT period, weekday_class, area_id, count(*) AS n, row_number() OVER (PARTITION BY period, weekday_class ORDER BY count(*) DESC, area_id) AS rank FROM ok WHERE split = 'train' GROUP BY period, weekday_class, area_id")
def global_popularity(spark, sf_dir):
    return attraction.popularity(train(spark, sf_dir), ["period", "weekday_class"])


ORIGIN_RANK = ATTRACTION + """, pop AS (SELECT origin_id, period, weekday_class, area_id, count(*) AS n FROM ok WHERE split = 'train' GROUP BY ALL),
ar AS (SELECT period, weekday_class, area_id, row_number() OVER (PARTITION BY period, weekday_class ORDER BY round(area_score, 9) DESC, visits DESC, area_id) AS rank FROM attr),
og AS (SELECT o.area_id AS origin_id, attr.period, attr.weekday_class, attr.area_id, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY o.area_id, attr.period, attr.weekday_class ORDER BY coalesce(n, 0) DESC, visits DESC, attr.area_id) AS rank
  FROM attr CROSS JOIN areas o LEFT JOIN pop ON pop.origin_id = o.area_id AND pop.period = attr.period AND pop.weekday_class = attr.weekday_class AND pop.area_id = attr.area_id)
"""


def _origin_ranks(spark, sf_dir, top):
    t = stored(train(spark, sf_dir), "train")
    scored = stored(_scored(t, spark).withColumn("area_score", F.round("area_score", 9)), "scored")
    origins = areas(spark).select(F.col("area_id").alias("origin_id")).crossJoin(F.broadcast(attraction.contexts(spark)))  # 10 contexts
    by = ["origin_id", *attraction.CONTEXT]
    return demo.rank_from_origin(origins, attraction.popularity(t, by), scored, by, top), scored


@query(ORIGIN_RANK + "SELECT origin_id, period, weekday_class, area_id, n, rank FROM og WHERE rank <= 10")
def origin_rank(spark, sf_dir):
    return _origin_ranks(spark, sf_dir, 10)[0].select("origin_id", "period", "weekday_class", "area_id", "n", "rank")


@query(ORIGIN_RANK + """, q AS (SELECT trip_id, origin_id, period, weekday_class, area_id FROM ok WHERE split = 'validation'),
pos AS (SELECT 'origin_period' AS model, rank FROM q LEFT JOIN og USING (origin_id, period, weekday_class, area_id) UNION ALL SELECT 'area_attraction', rank FROM q LEFT JOIN ar USING (period, weekday_class, area_id))
SELECT model, count(*) AS rows_in_scope, 1::DOUBLE AS destination_coverage, count(*) AS evaluated, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 5 THEN 1::DOUBLE / rank ELSE 0 END), 6) AS mrr5 FROM pos GROUP BY model""")
def smoke_metrics(spark, sf_dir):
    own, scored = _origin_ranks(spark, sf_dir, 5)
    best = attraction.rank_areas(scored, attraction.CONTEXT, 5)
    asked = eligible(trips(spark, sf_dir)).where("split = 'validation'").select("trip_id", "origin_id", *attraction.CONTEXT, "area_id")
    place = lambda ranks, name, by: asked.join(ranks.select(*by, "area_id", "rank"), [*by, "area_id"], "left").select(F.lit(name).alias("model"), F.col("area_id").alias("actual"), "rank")
    both = place(own, "origin_period", ["origin_id", *attraction.CONTEXT]).unionByName(place(best, "area_attraction", attraction.CONTEXT))
    return rounded(demo.smoke_metrics(both))


PROFILES = """, prof AS (SELECT rider_id, count(*) AS trip_count, CASE WHEN count(*) >= 10 THEN 'full' WHEN count(*) >= 3 THEN 'light' ELSE 'cold' END AS level,
  quantile_cont(distance_km, 0.25) AS p25_km, quantile_cont(distance_km, 0.5) AS median_km, quantile_cont(distance_km, 0.75) AS p75_km, quantile_cont(distance_km, 0.9) AS p90_km, quantile_cont(travel_time_min, 0.5)::DOUBLE AS median_min,
  """ + ", ".join(f"(count(*) FILTER (period = '{p}'))::DOUBLE / count(*) AS {p}_ratio" for p in riders.PERIODS) + """,
  (count(*) FILTER (weekday_class = 'weekend'))::DOUBLE / count(*) AS weekend_ratio, (count(*) FILTER (origin_id <> area_id))::DOUBLE / count(*) AS cross_area_ratio, avg(fare_midpoint) AS fare_mean
  FROM ok WHERE split = 'train' GROUP BY rider_id)
"""
_PROFILE = [*riders.NUMERIC[:4], "median_min", *riders.NUMERIC[4:], "weekend_ratio", "cross_area_ratio", "fare_mean"]


@query(PROFILES + "SELECT rider_id, trip_count, level, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PROFILE) + " FROM prof")
def rider_profiles(spark, sf_dir):
    return rounded(riders.rider_profiles(train(spark, sf_dir)))


@query(PROFILES + "SELECT level, count(*) AS riders, sum(trip_count)::BIGINT AS trips FROM prof GROUP BY level")
def rider_tiers(spark, sf_dir):
    return riders.tier_counts(train(spark, sf_dir))


@query(PROFILES + "SELECT rider_id, area_id, period, count(*) AS visits, round(count(*)::DOUBLE / any_value(trip_count), 6) AS visit_ratio FROM ok JOIN prof USING (rider_id) WHERE split = 'train' GROUP BY rider_id, area_id, period")
def rider_area_stats(spark, sf_dir):
    return rounded(riders.rider_areas(train(spark, sf_dir)))


@query(PROFILES + "SELECT level, count(*) AS trips, " + ", ".join(f"round(quantile_cont(distance_km, {q / 100}), 6) AS p{q}" for q in (25, 50, 75, 90)) + " FROM ok JOIN prof USING (rider_id) WHERE split = 'train' GROUP BY level")
def cohort_quantiles(spark, sf_dir):
    return rounded(riders.cohort_quantiles(stored(train(spark, sf_dir).select("rider_id", "distance_km"), "trips")))


@query(PROFILES + ", ra AS (SELECT rider_id, area_id, period, count(*) AS visits FROM ok JOIN prof USING (rider_id) WHERE split = 'train' AND level <> 'cold' GROUP BY ALL) SELECT round(quantile_cont(ln(1 + visits::DOUBLE), 0.05), 6) AS p5, round(quantile_cont(ln(1 + visits::DOUBLE), 0.95), 6) AS p95 FROM ra")
def b_scale(spark, sf_dir):
    t = stored(train(spark, sf_dir), "trips")
    return rounded(riders.b_scale(riders.rider_areas(t), riders.rider_profiles(t)))


@query("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT vec_id, neighbour, round(round(s, 12), 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, neighbour) AS rank FROM p WHERE s > 0)
SELECT * FROM r WHERE rank <= 50""", view=False)
def cosine_topk(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = e.withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0")
    return rounded(riders.cosine_neighbours(e.select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("v")), key="vec_id"))


NEAR = PROFILES + ", st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in riders.NUMERIC) + """ FROM prof WHERE level = 'full'),
num AS (SELECT rider_id, unnest([""" + ", ".join(f"'{c}'" for c in riders.NUMERIC) + "]) AS dim, unnest([" + ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END" for c in riders.NUMERIC) + """]) AS w FROM prof CROSS JOIN st WHERE level = 'full'),
ar AS (SELECT rider_id, 'area-' || area_id AS dim, ln(1 + count(*)::DOUBLE) AS w FROM ok JOIN prof USING (rider_id) WHERE split = 'train' AND level = 'full' GROUP BY rider_id, area_id),
vec AS (SELECT rider_id, dim, 0.6 * w / sqrt(sum(w * w) OVER (PARTITION BY rider_id)) AS w FROM num UNION ALL SELECT rider_id, dim, 0.4 * w / sqrt(sum(w * w) OVER (PARTITION BY rider_id)) FROM ar),
unit AS (SELECT rider_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY rider_id)) AS w FROM vec),
sim AS (SELECT a.rider_id, b.rider_id AS neighbour, round(sum(a.w * b.w), 12) AS s FROM unit a JOIN unit b USING (dim) WHERE a.rider_id <> b.rider_id GROUP BY ALL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY s DESC, neighbour) AS rank FROM sim WHERE s > 0) WHERE rank <= 50)
"""
B_SCORES = NEAR + """, va AS (SELECT rider_id AS neighbour, area_id, period, count(*) AS visits FROM ok WHERE split = 'train' GROUP BY ALL),
bl AS (SELECT quantile_cont(ln(1 + visits::DOUBLE), 0.05) AS p5, quantile_cont(ln(1 + visits::DOUBLE), 0.95) AS p95 FROM va JOIN prof ON neighbour = rider_id WHERE level <> 'cold'),
tn AS (SELECT rider_id, sum(s) AS total FROM nb GROUP BY rider_id HAVING count(*) >= 5),
bs AS (SELECT rider_id, period, area_id, greatest(0, least(1, (sum(s * ln(1 + visits::DOUBLE)) / any_value(total) - any_value(p5)) / (any_value(p95) - any_value(p5)))) AS b_score, greatest(0, least(1, -any_value(p5) / (any_value(p95) - any_value(p5)))) AS b_zero
  FROM nb JOIN tn USING (rider_id) JOIN va USING (neighbour) CROSS JOIN bl WHERE abs(p95 - p5) > 1e-12 GROUP BY rider_id, period, area_id)
"""


@query(NEAR + "SELECT rider_id, neighbour, round(s, 6) AS similarity, rank FROM nb", grouped=True)
def rider_neighbours(spark, sf_dir):
    return rounded(_b_parts(stored(grouped_riders(train(spark, sf_dir)), "fit"))[1])


@query(B_SCORES + "SELECT rider_id, period, area_id, round(b_score, 6) AS b_score, round(b_zero, 6) AS b_zero FROM bs", grouped=True)
def b_scores(spark, sf_dir):
    return rounded(evaluate.b_scores(*_b_parts(stored(grouped_riders(train(spark, sf_dir)), "fit"))))


def _b_parts(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Riders with a B score, their neighbours, visits and the scale."""
    profiles, visits = stored(riders.rider_profiles(t), "profiles"), stored(riders.rider_areas(t), "visits")
    near = stored(riders.cosine_neighbours(riders.dense(riders.rider_vectors(profiles, visits))), "near")
    return profiles.where("level = 'full'"), near, visits, riders.b_scale(visits, profiles)


#: Questions of a split with all areas in reach, and their four scores.
QUESTIONS = """, q AS (SELECT trip_id, rider_id, period, weekday_class, origin_id, area_id AS actual, (p_lat::DOUBLE / 1000) AS lat, (p_lng::DOUBLE / 1000) AS lng, split FROM trips WHERE NOT duplicate),
qa AS (SELECT q.*, areas.area_id AS candidate, 1.3 * 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(areas.lat) - radians(q.lat)) / 2), 2) + cos(radians(q.lat)) * cos(radians(areas.lat)) * pow(sin((radians(areas.lng) - radians(q.lng)) / 2), 2)))) AS distance FROM q CROSS JOIN areas)
"""


def _questions(t: DataFrame, split: str) -> DataFrame:
    """All first occurrences of a split; evaluation doesn't ask for eligibility."""
    milli = lambda c: (F.col(c) / F.lit(1000.0))
    return t.where(~F.col("duplicate") & (F.col("split") == split)).select("trip_id", "rider_id", "period", "weekday_class", "origin_id", F.col("area_id").alias("actual"), milli("p_lat").alias("lat"), milli("p_lng").alias("lng"))


@query(QUESTIONS + "SELECT candidate, count(*) AS n, round(avg(distance), 6) AS mean_km, round(max(distance), 6) AS max_km FROM qa WHERE split = 'test' AND distance <= 20 GROUP BY candidate")
def candidate_areas(spark, sf_dir):
    rows = evaluate.candidates(_questions(trips(spark, sf_dir), "test"), areas(spark))
    return rounded(rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_km"), F.max("distance").alias("max_km")))


SCORES = ATTRACTION + PROFILES + QUESTIONS + """, gp AS (SELECT period, weekday_class, area_id AS candidate, count(*) AS g FROM ok WHERE split = 'train' GROUP BY ALL),
op AS (SELECT origin_id, period, weekday_class, area_id AS candidate, count(*) AS o FROM ok WHERE split = 'train' GROUP BY ALL),
og AS (SELECT DISTINCT origin_id, period, weekday_class, TRUE AS has FROM op),
rv AS (SELECT rider_id, area_id AS candidate, count(*) AS visits FROM ok WHERE split = 'train' GROUP BY ALL),
rm AS (SELECT rider_id, max(visits) AS most FROM rv GROUP BY rider_id),
li AS (SELECT quantile_cont(distance_km, 0.25) AS l25, quantile_cont(distance_km, 0.75) AS l75, quantile_cont(distance_km, 0.9) AS l90 FROM ok JOIN prof USING (rider_id) WHERE split = 'train' AND level = 'light'),
pc AS (SELECT rider_id, level, trip_count, weekend_ratio, morning_ratio, lunch_ratio, afternoon_ratio, dinner_ratio, night_ratio, most,
  CASE WHEN level = 'full' THEN p25_km ELSE least(median_km, l25) END AS a25, CASE WHEN level = 'full' THEN p75_km ELSE greatest(median_km, l75) END AS a75,
  CASE WHEN level = 'full' THEN p90_km ELSE greatest(greatest(median_km, l75) + 0.1, l90) END AS a90 FROM prof JOIN rm USING (rider_id) CROSS JOIN li WHERE level <> 'cold'),
s0 AS (SELECT qa.*, coalesce(g, 0) AS global_score, CASE WHEN og.has THEN coalesce(o, 0) ELSE coalesce(g, 0) END AS origin_score, attr.area_score AS a_score, pc.* EXCLUDE (rider_id, level), coalesce(rv.visits, 0) AS rvisits,
  CASE period WHEN 'morning' THEN morning_ratio WHEN 'lunch' THEN lunch_ratio WHEN 'afternoon' THEN afternoon_ratio WHEN 'dinner' THEN dinner_ratio ELSE night_ratio END AS pr,
  CASE weekday_class WHEN 'weekend' THEN weekend_ratio ELSE 1 - weekend_ratio END AS wr
  FROM qa LEFT JOIN gp USING (period, weekday_class, candidate) LEFT JOIN op USING (origin_id, period, weekday_class, candidate) LEFT JOIN og USING (origin_id, period, weekday_class)
  JOIN attr ON attr.area_id = qa.candidate AND attr.period = qa.period AND attr.weekday_class = qa.weekday_class LEFT JOIN pc ON pc.rider_id = qa.rider_id LEFT JOIN rv ON rv.rider_id = qa.rider_id AND rv.candidate = qa.candidate WHERE distance <= 20),
s1 AS (SELECT *, CASE WHEN trip_count IS NULL THEN NULL ELSE greatest(0, least(1, 0.5 * CASE WHEN distance < a25 THEN greatest(0, least(1, 0.35 + 0.65 * distance / a25)) WHEN distance <= a75 THEN 1 WHEN distance <= a90 THEN 1 - 0.35 * (distance - a75) / (a90 - a75) ELSE greatest(0, least(1, 0.65 * exp(-(distance - a90) / a90))) END
  + 0.2 * (pr * trip_count + 1) / (trip_count + 5) + 0.15 * (wr * trip_count + 1) / (trip_count + 2) + 0.15 * ln(1 + rvisits::DOUBLE) / ln(1 + most::DOUBLE))) END AS c_score FROM s0)
"""


def _asked(spark, sf_dir, split, b=False):
    """The questions of a split with their candidates and what these score by."""
    t = trips(spark, sf_dir).where(~F.col("duplicate") & ((F.col("split") == split) | ((F.col("split") == "train") & is_eligible())))
    t = t.select("trip_id", "rider_id", "split", "duplicate", "period", "weekday_class", "day", "origin_id", "area_id", "p_lat", "p_lng", "distance_km", "travel_time_min", "fare_midpoint")
    t = stored(grouped_riders(t) if b else t, "trips")  # all below reads this one table
    fit = t.where("split = 'train'")
    as_candidate = F.col("area_id").alias("candidate")
    # stored tables have a known size: Spark broadcasts the small ones and shuffles for others
    kept = stored_all({
        "global": attraction.popularity(fit, ["period", "weekday_class"]).select("period", "weekday_class", as_candidate, F.col("n").alias("g")),
        "origin": attraction.popularity(fit, ["origin_id", "period", "weekday_class"]).select("origin_id", "period", "weekday_class", as_candidate, F.col("n").alias("o")),
        # next to no two trips of the view's own riders meet before a shuffle, those of groups do
        "profiles": riders.rider_profiles(fit if b else fit.repartition("rider_id")), "visits": fit.groupBy("rider_id", "area_id").agg(F.count(F.lit(1)).alias("visits")),
        "cohorts": riders.cohort_quantiles(fit), "grid": attraction.area_grid(fit, areas(spark)),
    }, at_once=2)
    scored = stored(attraction.area_attraction(kept["grid"]).select(as_candidate, "period", "weekday_class", "area_score").withColumnRenamed("area_score", "a_score"), "scored")
    terms = evaluate.rider_terms(kept["profiles"], kept["visits"], kept["cohorts"])
    zero = seen = None
    if b:
        parts = _b_parts(fit)
        zero, seen = evaluate.b_zero(parts[0], parts[1], parts[3]), evaluate.b_scores(*parts)
    return questions.asked(_questions(t, split), areas(spark), kept["global"], kept["origin"], scored, terms, kept["visits"], zero, seen)


def metrics_sql(models: dict[str, str]) -> str:
    """models: the SQL of each model's score over the columns of m."""
    return f""", m AS (SELECT s1.*, coalesce(prof.level, 'cold') AS tier, {{b}} FROM s1 LEFT JOIN prof USING (rider_id) {{joins}} WHERE split = 'test'),
long AS (SELECT *, unnest([{", ".join(f"'{m}'" for m in models)}]) AS model, unnest([{", ".join(models.values())}]) AS score FROM m),
rk AS (SELECT *, row_number() OVER (PARTITION BY trip_id, model ORDER BY round(score, 9) DESC, candidate) AS position FROM long),
per AS (SELECT trip_id, model, tier AS level, period, weekday_class, max(CASE WHEN candidate = actual THEN position END) AS place, sum(distance) FILTER (position <= 5) AS km, count(*) FILTER (position <= 5) AS items FROM rk GROUP BY ALL),
named AS (SELECT *, unnest(['overall', 'level', 'period', 'weekday_class']) AS grouping_, unnest(['all', level, period, weekday_class]) AS value FROM per),
g AS (SELECT model, grouping_, value, count(*) AS questions, count(place)::DOUBLE / count(*) AS candidate_coverage, sum(items) AS items,
  avg(CASE WHEN place <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit5, avg(CASE WHEN place <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hit10, avg(CASE WHEN place <= 5 THEN 1::DOUBLE / place ELSE 0 END) AS mrr5,
  avg(CASE WHEN place <= 5 THEN 1::DOUBLE / log2(place + 1) ELSE 0 END) AS ndcg5, sum(km) / sum(items) AS mean_km FROM named GROUP BY ALL),
top AS (SELECT model, candidate, unnest(['overall', 'level', 'period', 'weekday_class']) AS grouping_, unnest(['all', tier, period, weekday_class]) AS value FROM rk WHERE position <= 5),
cc AS (SELECT model, grouping_, value, count(*) AS shown, max(n) AS most FROM (SELECT model, grouping_, value, candidate, count(*) AS n FROM top GROUP BY ALL) GROUP BY ALL)
SELECT model, grouping_ AS "grouping", value, questions, questions AS verified, 1.0::DOUBLE AS destination_coverage, round(candidate_coverage, 6) AS candidate_coverage, round(hit5, 6) AS hit5, round(hit10, 6) AS hit10, round(mrr5, 6) AS mrr5, round(ndcg5, 6) AS ndcg5,
  round(shown::DOUBLE / 36, 6) AS catalog_coverage, round(mean_km, 6) AS mean_km, round(most::DOUBLE / items, 6) AS concentration FROM g JOIN cc USING (model, grouping_, value)"""


def mean_sql(a: float, b: float, c: float) -> str:
    """A weighted mean over the scores that aren't null."""
    parts = [(w, x) for w, x in ((a, "a_score"), (b, "b_score"), (c, "c_score")) if w]
    total = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE {w}::DOUBLE * {x} END" for w, x in parts)
    return f"greatest(0, least(1, ({total}) / ({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE {w}::DOUBLE END' for w, x in parts)})))"


PLAIN = {"global_popularity": "global_score::DOUBLE", "origin_period": "origin_score::DOUBLE", "area_a": "a_score"}
WITH_B = "LEFT JOIN tn ON tn.rider_id = s1.rider_id LEFT JOIN bs ON bs.rider_id = s1.rider_id AND bs.period = s1.period AND bs.area_id = s1.candidate LEFT JOIN (SELECT DISTINCT b_zero AS zero FROM bs) ON TRUE"
B_SCORE = "CASE WHEN tn.rider_id IS NOT NULL THEN coalesce(bs.b_score, zero) END AS b_score"
BY = ["level", "period", "weekday_class"]


def _metrics(rows: DataFrame, weights: dict) -> DataFrame:
    return rounded(evaluate.summary_of_sums(*questions.outcome_sums(rows, weights, BY, 9), 36, BY))


@query(SCORES + metrics_sql(PLAIN | {"area_a_plus_c": mean_sql(0.3, 0, 0.7)}).format(b="NULL AS no_b", joins=""))
def metrics_by_group(spark, sf_dir):
    return _metrics(_asked(spark, sf_dir, "test"), {"area_a_plus_c": (0.3, 0.0, 0.7)})


@query(SCORES + """, v AS (SELECT * FROM s1 WHERE split = 'validation' AND c_score IS NOT NULL), w AS (SELECT i / 10::DOUBLE AS a FROM range(3, 10) t(i)),
rk AS (SELECT trip_id, a, candidate, actual, row_number() OVER (PARTITION BY trip_id, a ORDER BY round(greatest(0, least(1, a * a_score + round(1 - a, 1) * c_score)), 9) DESC, candidate) AS position FROM v CROSS JOIN w),
per AS (SELECT trip_id, a, max(CASE WHEN candidate = actual THEN position END) AS place FROM rk GROUP BY ALL),
g AS (SELECT a, count(*) AS questions, avg(CASE WHEN place <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit5, avg(CASE WHEN place <= 5 THEN 1::DOUBLE / place ELSE 0 END) AS mrr5 FROM per GROUP BY a)
SELECT 'area_a_plus_c' AS model, printf('%.1f/%.1f/%.1f', a, 0.0, 1 - a) AS weights, questions, round(hit5, 6) AS hit5, round(mrr5, 6) AS mrr5, row_number() OVER (ORDER BY round(hit5, 12) DESC, round(mrr5, 12) DESC, a DESC) AS rank FROM g""")
def weight_grid(spark, sf_dir):
    return rounded(questions.tune(_asked(spark, sf_dir, "validation"), digits=9))


SCORES_B = SCORES + B_SCORES.removeprefix(PROFILES)


@query(SCORES_B + f""", v AS (SELECT s1.*, {B_SCORE} FROM s1 {WITH_B} WHERE split = 'validation'),
wg AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for m, a, b, c in evaluate.weight_grid())}) t(model, a, b, c)),
rk AS (SELECT trip_id, model, a, b, c, candidate, actual, row_number() OVER (PARTITION BY trip_id, model, a, b, c ORDER BY round(greatest(0, least(1, a * a_score + CASE WHEN b > 0 THEN b * b_score ELSE 0 END + CASE WHEN c > 0 THEN c * c_score ELSE 0 END)), 9) DESC, candidate) AS position
  FROM v CROSS JOIN wg WHERE (b = 0 OR b_score IS NOT NULL) AND (c = 0 OR c_score IS NOT NULL)),
per AS (SELECT trip_id, model, a, b, c, coalesce(max(CASE WHEN candidate = actual THEN position END), count(*) + 1) AS place FROM rk GROUP BY ALL),
g AS (SELECT model, printf('%.1f/%.1f/%.1f', a, b, c) AS weights, a, count(*) AS questions, avg(CASE WHEN place <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit5, avg(CASE WHEN place <= 5 THEN 1::DOUBLE / place ELSE 0 END) AS mrr5 FROM per GROUP BY model, a, b, c)
SELECT model, weights, questions, round(hit5, 6) AS hit5, round(mrr5, 6) AS mrr5, row_number() OVER (PARTITION BY model ORDER BY round(hit5, 12) DESC, round(mrr5, 12) DESC, a DESC, weights) AS rank FROM g""", grouped=True)
def weight_grid_abc(spark, sf_dir):
    """All 35 weightings of the three models."""
    return rounded(questions.tune(_asked(spark, sf_dir, "validation", b=True), digits=9))


@query(SCORES_B + metrics_sql(PLAIN | {m: mean_sql(*w) for m, w in evaluate.DEFAULT_WEIGHTS.items()}).format(b=B_SCORE, joins=WITH_B), grouped=True)
def metrics_by_group_abc(spark, sf_dir):
    """All six rankers."""
    return _metrics(_asked(spark, sf_dir, "test", b=True), evaluate.DEFAULT_WEIGHTS)


#: Requests from suppliers and places from parts, by integer arithmetic.
SERVING = """, req AS (SELECT s_suppkey AS request_id, ((s_suppkey * 7) % 120)::DOUBLE / 1000 AS lat, ((s_suppkey * 11) % 120)::DOUBLE / 1000 AS lng,
  ['morning', 'lunch', 'afternoon', 'dinner', 'night'][s_suppkey % 5 + 1] AS period, ['weekday', 'weekend'][s_suppkey % 2 + 1] AS weekday_class, (6 + s_suppkey % 5)::DOUBLE AS budget_km FROM supplier),
dist AS (SELECT req.*, areas.area_id, 1.3 * 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(areas.lat) - radians(req.lat)) / 2), 2) + cos(radians(req.lat)) * cos(radians(areas.lat)) * pow(sin((radians(areas.lng) - radians(req.lng)) / 2), 2)))) AS distance FROM req CROSS JOIN areas)
"""


def _requests(spark, sf_dir):
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return s.select(k.alias("request_id"), ((k * 7) % 120 / F.lit(1000.0)).alias("lat"), ((k * 11) % 120 / F.lit(1000.0)).alias("lng"), pick(riders.PERIODS, 5).alias("period"), pick(("weekday", "weekend"), 2).alias("weekday_class"), (6 + k % 5).cast("double").alias("budget_km"))


@query(ATTRACTION + SERVING + """, b AS (SELECT request_id, dist.area_id, distance, budget_km, area_score, CASE WHEN distance <= 3 THEN 1 WHEN distance >= budget_km THEN 0.15 ELSE round(greatest(0.15, 0.85 - 0.7 * (distance - 3) / (budget_km - 3)), 6) END AS proximity
  FROM dist JOIN attr ON attr.area_id = dist.area_id AND attr.period = dist.period AND attr.weekday_class = dist.weekday_class WHERE distance <= budget_km),
r AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY round(0.8 * area_score + 0.2 * proximity, 6) DESC, area_id) AS rank, area_id, round(distance, 4) AS distance_km, round(area_score, 6) AS base_score, round(proximity, 6) AS proximity, round(0.8 * area_score + 0.2 * proximity, 6) AS score FROM b)
SELECT * FROM r WHERE rank <= 10""")
def serving_area_topk(spark, sf_dir):
    stats = _scored(train(spark, sf_dir), spark).select("area_id", "period", "weekday_class", "area_score")
    return rounded(serve.rank_areas(_requests(spark, sf_dir), areas(spark), stats))


@query(SERVING + "SELECT request_id, area_id, km FROM (SELECT request_id, area_id, round(distance / 1.3, 6) AS km, row_number() OVER (PARTITION BY request_id ORDER BY round(distance / 1.3, 9), area_id) AS k FROM dist) WHERE k = 1")
def nearest_area(spark, sf_dir):
    return rounded(serve.nearest_area(_requests(spark, sf_dir), areas(spark), "request_id"))


PLACES = """WITH place AS (SELECT p_partkey % 97 AS request_id, p_partkey AS place_id, p_partkey % 7 AS area_rank, ((p_partkey * 31) % 1000)::DOUBLE / 100 AS distance, p_size % 50 AS review_count,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1 + (p_partkey % 40)::DOUBLE / 10 END AS rating, round(1 - (p_partkey % 7)::DOUBLE / 10, 6) AS area_score FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id, area_rank ORDER BY distance, place_id) AS turn FROM place),
u AS (SELECT *, count(*) FILTER (turn <= 2) OVER (PARTITION BY request_id) AS early, count(*) OVER (PARTITION BY request_id) AS everything FROM t),
sl AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN turn <= 2 THEN 0 ELSE 1 END, CASE WHEN turn <= 2 THEN turn END, CASE WHEN turn <= 2 THEN area_rank END, distance, place_id) AS slot FROM u WHERE turn <= 2 OR early < least(5, everything)),
short AS (SELECT * FROM sl WHERE slot <= 20)
"""


def _places(spark, sf_dir):
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    return p.select((k % 97).alias("request_id"), k.alias("place_id"), (k % 7).alias("area_rank"), ((k * 31) % 1000 / F.lit(100.0)).alias("distance"), (F.col("p_size") % 50).alias("review_count"), F.when(k % 11 != 0, 1.0 + (k % 40) / F.lit(10.0)).alias("rating"), F.round(1.0 - (k % 7) / F.lit(10.0), 6).alias("area_score"))


@query(PLACES + "SELECT request_id, slot, place_id, area_rank, distance FROM short", view=False)
def shortlist_round_robin(spark, sf_dir):
    return serve.shortlist(_places(spark, sf_dir)).select("request_id", "slot", "place_id", "area_rank", "distance")


@query(PLACES + """, mx AS (SELECT *, max(review_count) OVER (PARTITION BY request_id) AS most, greatest(5, round(distance / 0.32)) AS minutes FROM short),
f AS (SELECT *, round(greatest(0, least(1, CASE WHEN minutes <= 20 THEN 1 WHEN minutes <= 30 THEN 1 - 0.35 * (minutes - 20) / 10 ELSE 0.65 * exp(-(minutes - 30) / 20) END)), 6) AS tf,
  round(greatest(0, least(1, CASE WHEN distance < 1 THEN 0.1 + 0.45 * distance WHEN distance <= 8 THEN 1 ELSE exp(-(distance - 8) / 8) END)), 6) AS rw FROM mx),
c AS (SELECT *, round(0.6 * tf + 0.4 * rw, 6) AS context_fit, CASE WHEN rating IS NULL AND most <= 0 THEN NULL ELSE round((CASE WHEN rating IS NULL THEN 0 ELSE 0.7 * least(1, rating / 5) END + CASE WHEN most > 0 THEN 0.3 * ln(1 + review_count::DOUBLE) / ln(1 + most::DOUBLE) ELSE 0 END) / (CASE WHEN rating IS NULL THEN 0 ELSE 0.7 END + CASE WHEN most > 0 THEN 0.3 ELSE 0 END), 6) END AS quality FROM f),
s AS (SELECT *, round(CASE WHEN quality IS NULL THEN (0.6 * area_score + 0.2 * context_fit) / 0.8 ELSE 0.6 * area_score + 0.2 * context_fit + 0.2 * quality END, 6) AS score FROM c)
SELECT request_id, rank, place_id FROM (SELECT request_id, place_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, review_count DESC, distance, place_id) AS rank FROM s) WHERE rank <= 5""", view=False)
def restaurant_topk(spark, sf_dir):
    rows = serve.shortlist(_places(spark, sf_dir)).withColumn("route_km", F.col("distance")).withColumn("route_min", F.greatest(F.lit(5.0), F.round(F.col("distance") / 0.32)))
    none = F.lit(None).cast("double")
    rows = rows.withColumn("typical_min", none).withColumn("p90_km", none).withColumn("light_p90", F.lit(8.0))
    return serve.restaurant_top(rows).select("request_id", "rank", "place_id")


@query("""WITH e AS (SELECT user_id::VARCHAR AS request_id, (event_id % 20)::VARCHAR AS place_key, event_type AS action, ts FROM events)
SELECT 'evt_' || left(sha256(request_id || '|' || place_key || '|' || action), 32) AS event_id, request_id, place_key, action, epoch_us(min(ts)) AS first_us, TRUE AS recorded FROM e GROUP BY request_id, place_key, action""", view=False)
def event_dedup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").cast("string").alias("request_id"), (F.col("event_id") % 20).cast("string").alias("place_key"), F.col("event_type").alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return serve.record_events(rows).withColumnRenamed("at", "first_us")


@query("""SELECT trip_id, pickup_region FROM (SELECT *, (row_number() OVER (PARTITION BY pickup_region ORDER BY sha256(trip_id::VARCHAR), trip_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY pickup_region) AS f FROM trips WHERE NOT duplicate)
ORDER BY f, pickup_region, sha256(trip_id::VARCHAR), trip_id LIMIT 500""")
def stratified_sample(spark, sf_dir):
    return area_ops.stratified_sample(trips(spark, sf_dir).where("not duplicate").select("trip_id", "pickup_region"), 500, "trip_id", "pickup_region")


@query(""", pt AS (SELECT area_id, d_lat::DOUBLE / 1000 AS lat, d_lng::DOUBLE / 1000 AS lng, pickup_region AS region FROM ok),
c AS (SELECT area_id, count(*) AS members, avg(lat) AS c_lat, avg(lng) AS c_lng FROM pt GROUP BY area_id),
d AS (SELECT area_id, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(c_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin((radians(c_lng) - radians(lng)) / 2), 2)))) AS km FROM pt JOIN c USING (area_id)),
r AS (SELECT area_id, region, count(*) AS n, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, region) AS k FROM pt GROUP BY area_id, region)
SELECT area_id, members, round(c_lat, 6) AS c_lat, round(c_lng, 6) AS c_lng, region, round(n::DOUBLE / members, 6) AS region_share, round((SELECT quantile_cont(km, 0.9) FROM d WHERE d.area_id = c.area_id), 6) AS radius_p90_km FROM c JOIN r USING (area_id) WHERE k = 1""")
def area_summary(spark, sf_dir):
    t = eligible(trips(spark, sf_dir))
    points = t.select("area_id", (F.col("d_lat") / F.lit(1000.0)).alias("lat"), (F.col("d_lng") / F.lit(1000.0)).alias("lng"), F.col("pickup_region").alias("region"))
    return rounded(area_ops.area_summary(points))


# Further queries, which register themselves.
from tripforge.plans import inputs, records, services  # noqa: E402, F401
