"""The composed services as queries over the driver's tables: requests come from suppliers,
places from parts, riders and fares from the trip view; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.operators import fares, riders, service
from tripforge.plans.registry import ATTRACTION, CUBE, PROFILES, _scored, query, rounded, train
from tripforge.plans.testbed import areas
from tripforge.sources.scratch import stored


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request a supplier, in the week from Monday, 2 February 2026; every ninth from far
    away. Riders exist for some of them."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    m = (k * 977) % 10080
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    at = F.concat(F.date_add(F.lit("2026-02-02").cast("date"), F.floor(m / 1440).cast("int")).cast("string"), F.lit(" "), two(F.floor(m / 60) % 24), F.lit(":"), two(m % 60), F.lit(":00"))
    rows = s.select(k.alias("request_id"), ((k * 13) % 1500 * 7 + k % 7 + 1).alias("rider_id"), ((k * 7) % 120 / F.lit(1000.0) + F.when(k % 9 == 0, 1.0).otherwise(0.0)).alias("lat"), ((k * 11) % 120 / F.lit(1000.0)).alias("lng"), F.to_timestamp(at).alias("at"))
    return service.with_context(rows)


def placed(spark: SparkSession) -> DataFrame:
    """The grid's areas with a radius and a region."""
    return areas(spark).withColumns({"radius_p90_km": (F.col("area_id") % 4) * 2.0 + 0.1, "region": F.when(F.col("area_id") < 18, "north").otherwise("south")})


REQUESTS = """req AS (SELECT s_suppkey AS request_id, (s_suppkey * 13) % 1500 * 7 + s_suppkey % 7 + 1 AS rider_id, ((s_suppkey * 7) % 120)::DOUBLE / 1000 + CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS lat, ((s_suppkey * 11) % 120)::DOUBLE / 1000 AS lng,
  CASE WHEN h < 11 THEN 'morning' WHEN h < 14 THEN 'lunch' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'dinner' ELSE 'night' END AS period, CASE WHEN d >= 5 THEN 'weekend' ELSE 'weekday' END AS weekday_class
  FROM (SELECT s_suppkey, ((s_suppkey * 977) % 10080 // 60) % 24 AS h, (s_suppkey * 977) % 10080 // 1440 AS d FROM supplier)),
spot AS (SELECT i AS area_id, ((i // 6) * 20 + 10)::DOUBLE / 1000 AS lat, ((i % 6) * 20 + 10)::DOUBLE / 1000 AS lng, (i % 4) * 2 + 0.1::DOUBLE AS radius, CASE WHEN i < 18 THEN 'north' ELSE 'south' END AS region FROM range(36) t(i))"""


def km_sql(a: str, b: str) -> str:
    """The distance in km of a.lat, a.lng and b.lat, b.lng."""
    a_lat, a_lng, b_lat, b_lng = f"{a}lat", f"{a}lng", f"{b}lat", f"{b}lng"
    return f"2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin((radians({b_lng}) - radians({a_lng})) / 2), 2))))"


@query("WITH " + REQUESTS + f""", near AS (SELECT * FROM (SELECT req.*, spot.area_id, radius, region, {km_sql('req.', 'spot.')} AS km FROM req CROSS JOIN spot) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(km, 9), area_id) = 1)
SELECT request_id, period, weekday_class, area_id AS nearest_area_id, region AS origin_region, km > greatest(2 * radius, 5) AS origin_fallback, CASE WHEN km <= greatest(2 * radius, 5) THEN area_id END AS origin_area_id FROM near""", view=False)
def request_origins(spark, sf_dir):
    found = service.origins(requests(spark, sf_dir), placed(spark))
    return found.select("request_id", "period", "weekday_class", "nearest_area_id", "origin_region", "origin_fallback", "origin_area_id")


@query(ATTRACTION + PROFILES + ", " + REQUESTS + f""", li AS (SELECT quantile_cont(distance_km, 0.25) AS l25, quantile_cont(distance_km, 0.75) AS l75, quantile_cont(distance_km, 0.9) AS l90 FROM ok JOIN prof USING (rider_id) WHERE split = 'train' AND level = 'light'),
went AS (SELECT rider_id, area_id, period, count(*) AS visits FROM ok WHERE split = 'train' GROUP BY ALL),
mo AS (SELECT rider_id, period, max(visits) AS most FROM went GROUP BY ALL),
b0 AS (SELECT req.*, level, trip_count, weekend_ratio, p25_km, p75_km, p90_km, median_km, CASE period WHEN 'morning' THEN morning_ratio WHEN 'lunch' THEN lunch_ratio WHEN 'afternoon' THEN afternoon_ratio WHEN 'dinner' THEN dinner_ratio ELSE night_ratio END AS ratio,
  CASE WHEN level <> 'cold' AND median_km > 0 THEN round_even(least(10, greatest(6, 1.5 * median_km)), 3) ELSE 8 END AS budget_km FROM req LEFT JOIN prof USING (rider_id)),
b1 AS (SELECT b0.*, spot.area_id, 1.3 * {km_sql('b0.', 'spot.')} AS distance, attr.area_score, coalesce(went.visits, 0) AS visits, coalesce(most, 0) AS most, l25, l75, l90
  FROM b0 CROSS JOIN spot CROSS JOIN li JOIN attr ON attr.area_id = spot.area_id AND attr.period = b0.period AND attr.weekday_class = b0.weekday_class LEFT JOIN went ON went.rider_id = b0.rider_id AND went.area_id = spot.area_id AND went.period = b0.period LEFT JOIN mo ON mo.rider_id = b0.rider_id AND mo.period = b0.period),
b2 AS (SELECT *, CASE WHEN level = 'full' THEN p25_km ELSE least(median_km, l25) END AS q25, CASE WHEN level = 'full' THEN p75_km ELSE greatest(median_km, l75) END AS q75, CASE WHEN level = 'full' THEN p90_km ELSE greatest(greatest(median_km, l75) + 0.1, l90) END AS q90 FROM b1 WHERE distance <= budget_km),
b3 AS (SELECT *, CASE WHEN distance < q25 THEN greatest(0, least(1, 0.35 + 0.65 * distance / greatest(q25, 0.01))) WHEN distance <= q75 THEN 1 WHEN distance <= q90 THEN greatest(0, 1 - 0.35 * (distance - q75) / greatest(q90 - q75, 0.01)) ELSE greatest(0, least(1, 0.65 * exp(-(distance - q90) / greatest(q90, 0.01)))) END AS fit,
  CASE WHEN distance <= 3 THEN 1 WHEN budget_km <= 3 OR distance >= budget_km THEN 0.15 ELSE round(greatest(0.15, 0.85 - 0.7 * (distance - 3) / (budget_km - 3)), 6) END AS near FROM b2),
b4 AS (SELECT *, CASE WHEN level IN ('full', 'light') THEN greatest(0, least(1, 0.5 * fit + 0.2 * (ratio * trip_count + 1) / (trip_count + 5) + 0.15 * (CASE WHEN weekday_class = 'weekend' THEN weekend_ratio ELSE 1 - weekend_ratio END * trip_count + 1) / (trip_count + 2) + 0.15 * CASE WHEN most > 0 THEN ln(1 + visits::DOUBLE) / ln(1 + most::DOUBLE) ELSE 0 END)) END AS c FROM b3),
b5 AS (SELECT *, round(0.8 * CASE WHEN c IS NULL THEN area_score ELSE 0.3 * area_score + 0.7 * c END + 0.2 * near, 6) AS score FROM b4)
SELECT request_id, area_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, area_id) AS rank, score, round(distance, 4) AS distance_km, round(area_score, 6) AS area_attraction, round(c, 6) AS personal_mobility, budget_km FROM b5 QUALIFY rank <= 10""")
def personal_areas(spark, sf_dir):
    """The ten best areas of each request in its rider's distance budget."""
    t = stored(train(spark, sf_dir), "trips")
    stats = stored(_scored(t, spark).select("area_id", "period", "weekday_class", "area_score"), "scored")
    profiles, cohort = stored(riders.rider_profiles(t), "profiles"), riders.cohort_quantiles(t).where("level = 'light'")
    return rounded(service.ranked_areas(requests(spark, sf_dir), placed(spark), stats, profiles, riders.rider_areas(t), cohort))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ranked areas of each request, with a personal score for some."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    rows = s.select(k.alias("request_id"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: (k * 5 + j * 7) % 36)).alias("j", "area_id"))
    own = F.when(F.col("request_id") % 3 > 0, F.round((F.col("request_id") % 10) / 10.0, 6))
    return rows.select("request_id", "area_id", (F.col("j") + 1).alias("rank"), F.round(0.95 - (F.col("j") + 1) / 10.0, 6).alias("score"), F.round(0.5 + F.col("area_id") / 100.0, 6).alias("area_attraction"), own.alias("personal_mobility"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider answered for each area, in the first circle and in the wider one."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    area = F.when(k % 4 == 0, 0).otherwise(k % 36)
    return p.select(
        area.cast("long").alias("area_id"), (F.floor(k / 36) % 3 == 0).alias("wide"), k.cast("int").alias("seq"), F.concat(F.lit("p"), (k % 150).cast("string")).alias("place_id"),
        ((k % 150 * 13) % 120 / F.lit(1000.0)).alias("lat"), ((k % 150 * 17) % 120 / F.lit(1000.0)).alias("lng"), F.when(k % 7 == 0, "closed").when(k % 5 == 0, "open").alias("open_status"),
        F.when(k % 150 % 11 != 0, 1.0 + (k % 150 % 40) / F.lit(10.0)).alias("rating"), F.when(k % 150 % 13 != 0, (k % 150) * 3).alias("review_count"),
    )


FOUND = "WITH " + REQUESTS + """, rk AS (SELECT s_suppkey AS request_id, (s_suppkey * 5 + j * 7) % 36 AS area_id, j AS rank, round(0.95 - j::DOUBLE / 10, 6) AS score, round(0.5 + ((s_suppkey * 5 + j * 7) % 36)::DOUBLE / 100, 6) AS area_attraction, CASE WHEN s_suppkey % 3 > 0 THEN round((s_suppkey % 10)::DOUBLE / 10, 6) END AS personal_mobility FROM supplier, range(1, 7) t(j)),
se AS (SELECT CASE WHEN k % 4 = 0 THEN 0 ELSE k % 36 END AS area_id, k // 36 % 3 = 0 AS wide, k AS seq, 'p' || (k % 150) AS place_id, ((k % 150 * 13) % 120)::DOUBLE / 1000 AS lat, ((k % 150 * 17) % 120)::DOUBLE / 1000 AS lng, CASE WHEN k % 7 = 0 THEN 'closed' WHEN k % 5 = 0 THEN 'open' END AS open_status,
  CASE WHEN k % 150 % 11 <> 0 THEN 1 + (k % 150 % 40)::DOUBLE / 10 END AS rating, CASE WHEN k % 150 % 13 <> 0 THEN (k % 150) * 3 END AS review_count FROM (SELECT p_partkey AS k FROM part)),
nn AS (SELECT area_id, count(*) FILTER (NOT wide) AS narrow FROM se GROUP BY area_id),
a0 AS (SELECT rk.*, coalesce(narrow, 0) BETWEEN 1 AND 9 AS again FROM rk LEFT JOIN nn USING (area_id)),
a1 AS (SELECT *, coalesce(sum(1 + again::INT) OVER (PARTITION BY request_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS made FROM a0),
a2 AS (SELECT *, again AND made + 1 < 10 AS use_wide FROM a1 WHERE made < 10),
p0 AS (SELECT request_id, a2.area_id, rank, score, seq, place_id, lat, lng, open_status, rating, review_count, row_number() OVER (PARTITION BY request_id, place_id ORDER BY rank, seq) AS turn FROM a2 JOIN se ON se.area_id = a2.area_id AND wide = use_wide WHERE coalesce(open_status, '') <> 'closed'),
p1 AS (SELECT *, coalesce(sum(CASE WHEN turn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY rank, seq, place_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS there FROM p0),
found AS (SELECT * FROM p1 WHERE there < 150 QUALIFY row_number() OVER (PARTITION BY request_id, place_id ORDER BY score DESC, rank, seq) = 1)
"""


@query(FOUND + "SELECT request_id, place_id, area_id, rank AS area_rank, score AS area_score, lat, lng, rating, review_count FROM found", view=False)
def provider_places(spark, sf_dir):
    """The open places of each request, each from its best area, within the bounds of calls."""
    found = service.found_places(ranks(spark, sf_dir), searches(spark, sf_dir))
    return found.select("request_id", "place_id", "area_id", "area_rank", "area_score", "lat", "lng", "rating", "review_count")


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 6")
    k = F.col("n_nationkey").cast("long")
    return n.select(F.concat(F.lit("n"), k.cast("string")).alias("place_id"), (k * 0.01 + 0.02).alias("lat"), (k * 0.02).alias("lng"), (3.0 + k % 3 * 0.5).alias("rating"), (k * 10).alias("review_count"))


def simple_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select((c * 7 + c % 7 + 1).alias("rider_id"), (c % 40 + 5).cast("double").alias("median_min"), (c % 12).cast("double").alias("p90_km"))


SHORT = f""", cn AS (SELECT request_id FROM found GROUP BY request_id HAVING count(*) >= 5),
pl AS (SELECT request_id, place_id, area_id, rank AS area_rank, score AS area_score, lat, lng, rating, review_count, 'live' AS restaurant_source FROM found WHERE request_id IN (FROM cn)
  UNION ALL SELECT request_id, 'n' || n_nationkey, area_id, rank, score, n_nationkey * 0.01::DOUBLE + 0.02, n_nationkey * 0.02::DOUBLE, 3 + n_nationkey % 3 * 0.5::DOUBLE, n_nationkey * 10, 'fallback_fixture' FROM rk, nation WHERE rank = 1 AND n_nationkey < 6 AND request_id NOT IN (FROM cn)),
di AS (SELECT pl.*, req.period, req.rider_id, {km_sql('req.', 'pl.')} AS distance FROM pl JOIN req USING (request_id)),
t1 AS (SELECT *, row_number() OVER (PARTITION BY request_id, area_rank ORDER BY distance, place_id) AS turn FROM di),
t2 AS (SELECT *, count(*) FILTER (turn <= 2) OVER (PARTITION BY request_id) AS early, count(*) OVER (PARTITION BY request_id) AS everything FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN turn <= 2 THEN 0 ELSE 1 END, CASE WHEN turn <= 2 THEN turn END, CASE WHEN turn <= 2 THEN area_rank END, distance, place_id) AS slot FROM t2 WHERE turn <= 2 OR early < least(5, everything)),
t4 AS (SELECT t3.*, round(1.3 * distance, 2) AS km, greatest(5, round(1.3 * distance / 0.32)) AS minutes, coalesce(median_min, 0) AS mm, coalesce(p90_km, 0) AS p90, max(coalesce(review_count, 0)) OVER (PARTITION BY request_id) AS most
  FROM t3 LEFT JOIN (SELECT c_custkey * 7 + c_custkey % 7 + 1 AS rider_id, (c_custkey % 40 + 5)::DOUBLE AS median_min, (c_custkey % 12)::DOUBLE AS p90_km FROM customer) USING (rider_id) WHERE slot <= 20),
t5 AS (SELECT *, CASE WHEN mm > 0 THEN mm ELSE 20 END AS ty, CASE WHEN p90 > 0 THEN p90 ELSE 8 END AS liked FROM t4),
t6 AS (SELECT *, round(greatest(0, least(1, CASE WHEN minutes <= ty THEN 1 WHEN minutes <= 1.5 * ty THEN 1 - 0.35 * (minutes - ty) / greatest(0.5 * ty, 1) ELSE 0.65 * exp(-(minutes - 1.5 * ty) / greatest(ty, 1)) END)), 6) AS tf,
  round(greatest(0, least(1, CASE WHEN km < 1 THEN 0.1 + 0.45 * km WHEN km <= least(10, liked) THEN 1 ELSE exp(-(km - least(10, liked)) / greatest(liked, 1)) END)), 6) AS rw FROM t5),
t7 AS (SELECT *, round(0.6 * tf + 0.4 * rw, 6) AS fit, CASE WHEN most > 0 AND review_count IS NOT NULL THEN greatest(0, least(1, ln(1 + review_count::DOUBLE) / ln(1 + most::DOUBLE))) END AS sure FROM t6),
t8 AS (SELECT *, CASE WHEN rating IS NULL AND sure IS NULL THEN NULL ELSE round((CASE WHEN rating IS NULL THEN 0 ELSE 0.7 * least(1, rating / 5) END + CASE WHEN sure IS NULL THEN 0 ELSE 0.3 * sure END) / (CASE WHEN rating IS NULL THEN 0 ELSE 0.7 END + CASE WHEN sure IS NULL THEN 0 ELSE 0.3 END), 6) END AS quality FROM t7),
t9 AS (SELECT *, round(CASE WHEN quality IS NULL THEN (0.6 * area_score + 0.2 * fit) / 0.8 ELSE 0.6 * area_score + 0.2 * fit + 0.2 * quality END, 6) AS total FROM t8),
items AS (SELECT t9.*, area_attraction, personal_mobility, row_number() OVER (PARTITION BY t9.request_id ORDER BY total DESC, coalesce(review_count, 0) DESC, km, place_id) AS place FROM t9 JOIN rk ON rk.request_id = t9.request_id AND rk.area_id = t9.area_id QUALIFY place <= 5)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = spark.createDataFrame([(1.0, 5.0, 8.0)], "p25 double, p75 double, p90 double")
    return service.recommend(requests(spark, sf_dir), ranks(spark, sf_dir), searches(spark, sf_dir), fixture(spark, sf_dir), cohort, simple_profiles(spark, sf_dir))


@query(FOUND + SHORT + """SELECT request_id, place AS rank, place_id AS place_key, area_id, total AS score, area_attraction, personal_mobility, fit AS context_fit, quality AS poi_quality, restaurant_source, 'fallback' AS route_source, km AS distance_km, minutes::INT AS minutes,
  left('For ' || period || ': ' || CASE WHEN personal_mobility IS NULL THEN 'popular nearby' WHEN personal_mobility >= 0.7 THEN 'close to your habits' ELSE 'a change from your habits' END, 60) AS explanation FROM items""", view=False)
def recommendations(spark, sf_dir):
    """The five best places of each request with their breakdown."""
    b = "score_breakdown"
    return _items(spark, sf_dir).select("request_id", "rank", "place_key", "area_id", "score", f"{b}.area_attraction", f"{b}.personal_mobility", f"{b}.context_fit", f"{b}.poi_quality", "restaurant_source", "route_source", "distance_km", "minutes", "explanation")


@query(FOUND + SHORT + """SELECT 'recommendation_items' AS stored_in, count(*) AS n_rows, count(DISTINCT request_id) AS n_requests FROM items
UNION ALL SELECT 'recommendation_requests', count(*), count(DISTINCT request_id) FROM req
UNION ALL SELECT 'feedback_events', count(DISTINCT sha256(request_id || '|' || place_id || '|impression')), count(DISTINCT request_id) FROM items""", view=False)
def request_records(spark, sf_dir):
    """What a batch of requests appends to the online tables."""
    asked = service.origins(requests(spark, sf_dir), placed(spark))
    out = service.records(asked, stored(_items(spark, sf_dir), "items"))
    count = lambda name, n: out[name].agg(F.lit(name).alias("stored_in"), n.alias("n_rows"), F.countDistinct("request_id").alias("n_requests"))
    every = F.count(F.lit(1))
    return count("recommendation_items", every).unionByName(count("recommendation_requests", every)).unionByName(count("feedback_events", F.countDistinct("event_id")))


@query(FOUND + SHORT + f""", near AS (SELECT request_id, km > greatest(2 * radius, 5) AS far FROM (SELECT req.request_id, radius, area_id, {km_sql('req.', 'spot.')} AS km FROM req CROSS JOIN spot) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(km, 9), area_id) = 1),
told AS (SELECT request_id, list(DISTINCT seq % 3) AS w FROM (SELECT user_id % 150 + 1 AS request_id, event_id AS seq FROM events) GROUP BY request_id),
src AS (SELECT request_id, min(restaurant_source) AS source FROM items GROUP BY request_id)
SELECT request_id, CASE WHEN source = 'fallback_fixture' THEN 1 ELSE 0 END + coalesce(len(w), 0) + far::INT AS n_warnings, coalesce(source = 'fallback_fixture', FALSE) AS fixture_places, far AS origin_fallback FROM near LEFT JOIN src USING (request_id) LEFT JOIN told USING (request_id)""", view=False)
def request_warnings(spark, sf_dir):
    """How many distinct warnings a request carries, and two of them by name."""
    asked = service.origins(requests(spark, sf_dir), placed(spark))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 150 + 1).alias("request_id"), F.col("event_id").alias("seq"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("warning"))
    w = F.col("warnings")
    return service.warnings(asked, stored(_items(spark, sf_dir), "items"), events).select("request_id", F.size(w).alias("n_warnings"), F.array_contains(w, "fixture_places").alias("fixture_places"), F.array_contains(w, "origin_fallback").alias("origin_fallback"))


@query(CUBE + ", " + REQUESTS + f""", item AS (SELECT DISTINCT s_suppkey % 97 AS request_id, 'p' || (s_suppkey % 50) AS place_key FROM supplier),
ask AS (SELECT o_orderkey AS ride_id, o_custkey % 120 AS request_id, 'p' || (o_orderkey % 50) AS place_key, ((o_orderkey * 7) % 120)::DOUBLE / 1000 AS lat, ((o_orderkey * 11) % 120)::DOUBLE / 1000 AS lng, ((o_custkey * 7) % 120)::DOUBLE / 1000 AS t_lat, ((o_custkey * 11) % 120)::DOUBLE / 1000 AS t_lng, o_orderkey % 24 AS h FROM orders WHERE o_orderstatus = 'F'),
nr AS (SELECT ride_id, region FROM (SELECT ask.ride_id, spot.region, spot.area_id, {km_sql('ask.', 'spot.')} AS km FROM ask CROSS JOIN spot) QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY round(km, 9), area_id) = 1),
e AS (SELECT ask.*, nr.region, CASE WHEN request_id NOT IN (SELECT request_id FROM item) THEN 'REQUEST_NOT_FOUND' WHEN item.place_key IS NULL THEN 'PLACE_NOT_IN_REQUEST' END AS error, round(1.3 * {km_sql('ask.', 'ask.t_')}, 2) AS km, greatest(5, round(1.3 * {km_sql('ask.', 'ask.t_')} / 0.32))::INT AS minutes,
  CASE WHEN h < 11 THEN 'morning' WHEN h < 14 THEN 'lunch' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'dinner' ELSE 'night' END AS period FROM ask JOIN nr USING (ride_id) LEFT JOIN item USING (request_id, place_key)),
bn AS (SELECT *, CASE WHEN km < 2 THEN '0-2' WHEN km < 5 THEN '2-5' WHEN km < 10 THEN '5-10' ELSE '10+' END AS distance_bin FROM e WHERE error IS NULL),
ru AS (SELECT ride_id, distance_bin, 0 AS rung, 'distance_period_region' AS source, period, region FROM bn UNION ALL SELECT ride_id, distance_bin, 1, 'distance_period_all_regions', period, 'all_regions' FROM bn UNION ALL SELECT ride_id, distance_bin, 2, 'distance_all_periods_region', 'all_periods', region FROM bn UNION ALL SELECT ride_id, distance_bin, 3, 'distance_only', 'all_periods', 'all_regions' FROM bn),
hi AS (SELECT * FROM ru JOIN cube USING (distance_bin, period, region) QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY rung) = 1)
SELECT e.ride_id, e.request_id, e.place_key, error, CASE WHEN error IS NULL THEN km END AS distance_km, CASE WHEN error IS NULL THEN minutes END AS minutes, CASE WHEN error IS NULL THEN 'fallback' END AS route_source, fare_p25 AS fare_lower, fare_p75 AS fare_upper, sample_count, source AS fare_source FROM e LEFT JOIN hi USING (ride_id)""")
def ride_estimates(spark, sf_dir):
    """Distance, minutes and fare range of rides to places of known requests."""
    s, o = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")
    items = s.select((F.col("s_suppkey") % 97).alias("request_id"), F.concat(F.lit("p"), (F.col("s_suppkey") % 50).cast("string")).alias("place_key"))
    at = lambda c, n: F.col(c) * n % 120 / F.lit(1000.0)
    clock = F.concat(F.lit("2026-02-02 "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30:00"))
    asked = o.select(F.col("o_orderkey").alias("ride_id"), (F.col("o_custkey") % 120).alias("request_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 50).cast("string")).alias("place_key"), at("o_orderkey", 7).alias("o_lat"), at("o_orderkey", 11).alias("o_lng"), at("o_custkey", 7).alias("lat"), at("o_custkey", 11).alias("lng"), F.to_timestamp(clock).alias("at"))
    return service.estimate_ride(asked, items, placed(spark), fares.fare_cube(train(spark, sf_dir)))


@query(f"""WITH pl AS (SELECT p_partkey % 97 AS request_id, p_partkey AS slot, (p_partkey % 40)::DOUBLE / 1000 AS lat, (p_partkey % 30)::DOUBLE / 1000 AS lng, ((p_partkey * 7) % 120)::DOUBLE / 1000 AS t_lat, ((p_partkey * 11) % 120)::DOUBLE / 1000 AS t_lng FROM part),
ro AS (SELECT p_partkey % 97 AS request_id, p_partkey AS slot, p_partkey::DOUBLE / 100 AS km, 5 + p_partkey % 50 AS minutes FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 2 = 0 AND p_partkey % 5 > 0)
SELECT request_id, slot, coalesce(km, round(1.3 * {km_sql('pl.', 'pl.t_')}, 2)) AS route_km, coalesce(minutes, greatest(5, round(1.3 * {km_sql('pl.', 'pl.t_')} / 0.32)))::INT AS route_min, CASE WHEN km IS NULL THEN 'fallback' ELSE 'live' END AS route_source FROM pl LEFT JOIN ro USING (request_id, slot)""", view=False)
def live_routes(spark, sf_dir):
    """Routes as a provider gave them where there is one, or else the fallback."""
    from tripforge.operators import serve

    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    at = lambda n, m: k * n % m / F.lit(1000.0)
    places = p.select((k % 97).alias("request_id"), k.alias("slot"), at(1, 40).alias("o_lat"), at(1, 30).alias("o_lng"), at(7, 120).alias("lat"), at(11, 120).alias("lng"))
    condition, status = F.when(k % 2 == 0, "ROUTE_EXISTS").otherwise("ROUTE_NOT_FOUND"), F.when(k % 5 > 0, "ok")
    routes = p.where(k % 3 > 0).select((k % 97).alias("request_id"), k.alias("slot"), condition.alias("condition"), status.alias("status"), (k / F.lit(100.0)).alias("km"), (5 + k % 50).cast("int").alias("minutes"))
    return serve.with_routes(places, routes).select("request_id", "slot", "route_km", "route_min", "route_source")


@query("SELECT p_partkey % 20 AS request_id, p_partkey % 90 AS place_id, (p_partkey % 7)::DOUBLE / 10 AS source_area_score, p_partkey AS seq FROM part WHERE p_partkey % 6 > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey % 20, p_partkey % 90 ORDER BY p_partkey % 7 DESC, p_partkey) = 1", view=False)
def best_sources(spark, sf_dir):
    """Each open place once, from the area of its highest score, first seen."""
    from tripforge.operators import serve

    k = F.col("p_partkey")
    places = spark.read.parquet(f"{sf_dir}/part.parquet").select((k % 20).alias("request_id"), (k % 90).alias("place_id"), (k % 7 / F.lit(10.0)).alias("source_area_score"), k.alias("seq"), F.when(k % 6 == 0, "closed").when(k % 4 == 0, "open").alias("open_status"))
    return serve.best_source(places).drop("open_status")


@query("""WITH g AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'eligible' ELSE 'all' END AS policy, p_partkey // 2 AS size, CASE WHEN p_partkey % 9 = 0 THEN 'skipped' ELSE 'ok' END AS status, p_partkey * 3 % 41 AS clusters, (p_partkey * 7 % 100)::DOUBLE / 100 AS noise, (p_partkey * 11 % 100)::DOUBLE / 100 AS cover FROM part)
SELECT a.size, b.clusters - a.clusters AS clusters_delta, round(b.noise - a.noise, 6) AS noise_ratio_delta, round(b.cover - a.cover, 6) AS taipei_delta FROM g a JOIN g b ON a.size = b.size AND a.policy = 'all' AND b.policy = 'eligible' AND a.status = 'ok' AND b.status = 'ok'""", view=False)
def policy_deltas(spark, sf_dir):
    """What one policy of candidates changes against another."""
    from tripforge.operators import density

    k = F.col("p_partkey")
    grid = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.when(k % 2 == 0, "eligible").otherwise("all").alias("policy"), F.floor(k / 2).alias("size"), F.lit(5).alias("min_cluster_size"), F.lit(2).alias("min_samples"), F.when(k % 9 == 0, "skipped").otherwise("ok").alias("status"),
        (k * 3 % 41).alias("clusters"), (k * 7 % 100 / F.lit(100.0)).alias("noise_ratio"), F.create_map(F.lit("Taipei"), k * 11 % 100 / F.lit(100.0)).alias("coverage"),
    )
    found = density.policy_deltas(grid, "all", "eligible")
    return found.select("size", "clusters_delta", F.round("noise_ratio_delta", 6).alias("noise_ratio_delta"), F.round(F.col("coverage_delta")["Taipei"], 6).alias("taipei_delta"))
