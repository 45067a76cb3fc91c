"""Queries of what comes from outside (times, checks, settings, routes), of the demo, and of
digests, over texts that are made from the driver's tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripforge.functions import requests
from tripforge.operators import areas as area_ops, attraction, demo, digests, release
from tripforge.functions.geo import region_bucket
from tripforge.functions.scoring import distance_budget_km, rider_key
from tripforge.plans.registry import ORIGIN_RANK, _scored, query, train
from tripforge.plans.testbed import trips
from tripforge.sources.scratch import stored

#: A time of an order, with one of several offsets or none; the same text for both engines.
_OFFSETS = ("Z", "+08:00", "-05:30", "", "+00:00", " late")
_STAMP = "'2026-0' || CAST(1 + o_orderkey % 9 AS STRING) || '-' || lpad(CAST(1 + o_custkey % 31 AS STRING), 2, '0') || 'T' || lpad(CAST(o_orderkey % 25 AS STRING), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ':30' ELSE '' END || CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_OFFSETS)) + " END"


@query(f"""WITH t AS (SELECT o_orderkey, {_STAMP} AS told, o_orderkey % 25 AS h, o_orderkey % 6 AS z FROM orders),
p AS (SELECT *, try_cast(left(told, 10) AS DATE) AS day, try_cast(left(told, 10) || ' ' || substr(told, 12, CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE 5 END) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ':00' END AS TIMESTAMP) AS clock, CASE z WHEN 1 THEN 480 WHEN 2 THEN -330 ELSE 0 END::BIGINT AS off FROM t)
SELECT o_orderkey, told, CASE WHEN ok THEN epoch_us(clock) - off * 60000000 END AS at_us, CASE WHEN ok THEN off END AS offset_min, CASE WHEN NOT ok THEN NULL WHEN h < 11 THEN 'morning' WHEN h < 14 THEN 'lunch' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'dinner' ELSE 'night' END AS period,
  CASE WHEN NOT ok THEN NULL WHEN isodow(day) < 6 THEN 'weekday' ELSE 'weekend' END AS weekday_class FROM (SELECT *, z NOT IN (3, 5) AND h < 24 AND day IS NOT NULL AND clock IS NOT NULL AS ok FROM p)""", view=False)
def request_times(spark, sf_dir):
    """Instants, and periods on the request's own clock."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_STAMP).alias("told"))
    t = requests.own_time(F.col("told"))
    period, day = requests.own_context(F.col("t"))
    return rows.withColumn("t", t).select("o_orderkey", "told", F.unix_micros("t.at").alias("at_us"), F.col("t.offset_min").alias("offset_min"), period.alias("period"), day.alias("weekday_class"))


_ASKED = {
    "alias": "CASE c_custkey % 5 WHEN 0 THEN 'demo_rider_full' WHEN 1 THEN 'demo_rider_light' WHEN 2 THEN 'demo_rider_cold' WHEN 3 THEN 'demo_rider_' ELSE NULL END",
    "name": "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 81) ELSE c_name END",
    "lat": "24.7D + c_custkey % 9 / 10.0D", "lng": "121.2D + c_custkey % 11 / 10.0D",
    "told": "CASE WHEN c_custkey % 4 = 0 THEN '2026-02-03T10:00' ELSE '2026-02-03T10:00+08:00' END",
    "request_id": "CASE WHEN c_custkey % 6 = 0 THEN 'rec_1' ELSE 'rec_' || lpad(CAST(c_custkey AS STRING), 16, '0') END",
    "place_key": "CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'p1' END",
    "action": "CASE c_custkey % 3 WHEN 0 THEN 'impression' WHEN 1 THEN 'ride_clicked' ELSE 'clicked' END",
}


@query("WITH a AS (SELECT c_custkey, " + ", ".join(f"{x.replace('24.7D', '24.7::DOUBLE').replace('121.2D', '121.2::DOUBLE').replace('10.0D', '10.0::DOUBLE')} AS {c}" for c, x in _ASKED.items()) + """ FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN alias IS NULL OR alias NOT IN ('demo_rider_full', 'demo_rider_light', 'demo_rider_cold') THEN 'rider_alias' END, CASE WHEN length(name) NOT BETWEEN 1 AND 80 THEN 'location.name' END, CASE WHEN lat NOT BETWEEN 24.8 AND 25.4 THEN 'location.latitude' END,
  CASE WHEN lng NOT BETWEEN 121.3 AND 122.1 THEN 'location.longitude' END, CASE WHEN length(told) = 16 THEN 'datetime' END], lambda x: x IS NOT NULL), ';') AS recommendation,
  array_to_string(list_filter([CASE WHEN length(request_id) <> 20 THEN 'request_id' END, CASE WHEN place_key = '' THEN 'place_key' END, CASE WHEN action = 'clicked' THEN 'action' END], lambda x: x IS NOT NULL), ';') AS feedback FROM a""", view=False)
def request_checks(spark, sf_dir):
    """The fields that the contracts of requests and feedback reject."""
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *[F.expr(x).alias(c) for c, x in _ASKED.items()])
    asked = requests.recommendation_errors(F.col("alias"), F.col("name"), F.col("lat"), F.col("lng"), F.col("told"))
    return a.select("c_custkey", F.array_join(asked, ";").alias("recommendation"), F.array_join(requests.feedback_errors(F.col("request_id"), F.col("place_key"), F.col("action")), ";").alias("feedback"))


_CONFIG = """CASE s_suppkey % 7 WHEN 0 THEN '{"weights": {"a": 0.' || CAST(s_suppkey % 9 AS STRING) || ', "c": 0.5}, "cohort_distance_reference": {"light": {"p90": 8}}}' WHEN 1 THEN '{}' WHEN 2 THEN NULL WHEN 3 THEN '{"weights"' WHEN 4 THEN '[3]' WHEN 5 THEN '{"weights": 1, "cohort_distance_reference": "x"}' ELSE '{"weights": {"c": 0.25}}' END"""


@query("SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN (s_suppkey % 9)::DOUBLE / 10 ELSE 0.3::DOUBLE END AS a, CASE s_suppkey % 7 WHEN 0 THEN 0.5::DOUBLE WHEN 6 THEN 0.25::DOUBLE ELSE 0.7::DOUBLE END AS c, CASE s_suppkey % 7 WHEN 0 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS n_weights, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS n_cohorts FROM supplier", view=False)
def serving_configs(spark, sf_dir):
    """Settings of releases, whatever their text is."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", requests.serving_config(F.expr(_CONFIG)).alias("s"))
    return rows.select("s_suppkey", requests.weight(F.col("s"), "a").alias("a"), requests.weight(F.col("s"), "c").alias("c"), F.size("s.weights").alias("n_weights"), F.size("s.cohort").alias("n_cohorts"))


_DURATION = "CASE p_partkey % 5 WHEN 0 THEN 'soon' WHEN 1 THEN NULL WHEN 2 THEN CAST(p_partkey % 700 AS STRING) || '.5s' ELSE CAST(p_partkey % 3000 AS STRING) || 's' END"


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN p_partkey % 700 + 0.5::DOUBLE WHEN 3 THEN p_partkey % 3000 WHEN 4 THEN p_partkey % 3000 END::DOUBLE AS s FROM part)
SELECT p_partkey, round_even(s, 0)::BIGINT AS seconds, greatest(1, round_even(round_even(s, 0) / 60, 0))::BIGINT AS minutes, round((p_partkey * 7 // 10 * 10)::DOUBLE / 1000, 2) AS km, ['open', 'closed', 'unknown'][p_partkey % 3 + 1] AS open_status FROM (SELECT p_partkey, s FROM d WHERE s IS NOT NULL)
UNION ALL SELECT p_partkey, NULL, NULL, round((p_partkey * 7 // 10 * 10)::DOUBLE / 1000, 2), ['open', 'closed', 'unknown'][p_partkey % 3 + 1] FROM d WHERE s IS NULL""", view=False)
def route_fields(spark, sf_dir):
    """Durations, distances and opening as providers tell them."""
    k, rows = F.col("p_partkey"), spark.read.parquet(f"{sf_dir}/part.parquet")
    told = F.expr(_DURATION)
    minutes = requests.route_minutes(told)
    return rows.select("p_partkey", requests.duration_seconds(told).alias("seconds"), minutes.alias("minutes"), requests.route_km((F.floor(k * 7 / 10) * 10).cast("string")).alias("km"), requests.open_status(F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("open_status"))


@query("""WITH h AS (SELECT o_orderkey, sha256(concat_ws(chr(31), 'o_custkey=' || o_custkey, 'o_orderkey=' || o_orderkey, coalesce('o_orderpriority=' || o_orderpriority, 'o_orderpriority'), 'o_orderstatus=' || o_orderstatus, 'o_totalprice=' || printf('%.8f', o_totalprice))) AS h FROM orders),
r AS (SELECT h, row_number() OVER (ORDER BY o_orderkey, h) - 1 AS place FROM h),
a AS (SELECT place // 4096 AS place, sha256(string_agg(h, ',' ORDER BY place)) AS h FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n_rows, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, ',' ORDER BY place)) END AS digest FROM a""", view=False)
def table_digest(spark, sf_dir):
    """A digest of the orders in their order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 >= 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus", "o_totalprice")
    return digests.ordered_digest(rows, ["o_orderkey"])


@query(ORIGIN_RANK + """, rq AS (SELECT s_suppkey AS request_id, s_suppkey % 36 AS origin_id, s_suppkey % 3 > 0 AS dense, ['morning', 'lunch', 'afternoon', 'dinner', 'night'][s_suppkey % 5 + 1] AS period, ['weekday', 'weekend'][s_suppkey % 2 + 1] AS weekday_class FROM supplier)
SELECT request_id, 'origin_period_popularity' AS model, FALSE AS fallback_used, rank, area_id, n::DOUBLE AS score FROM rq JOIN og USING (origin_id, period, weekday_class) WHERE dense AND rank <= 5
UNION ALL SELECT request_id, 'area_attraction_fallback', TRUE, rank, area_id, round(area_score, 6) FROM rq JOIN ar USING (period, weekday_class) JOIN attr USING (period, weekday_class, area_id) WHERE NOT dense AND rank <= 5""")
def demo_recommendations(spark, sf_dir):
    """Recommendations from features alone: an origin's favourites, or else the best areas."""
    t = stored(train(spark, sf_dir), "train")
    scored = stored(_scored(t, spark).withColumn("area_score", F.round("area_score", 9)), "scored")
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    asked = s.select(k.alias("request_id"), (k % 36).alias("origin_id"), F.when(k % 3 > 0, "density").otherwise("fallback").alias("assignment"), pick(("morning", "lunch", "afternoon", "dinner", "night"), 5).alias("period"), pick(("weekday", "weekend"), 2).alias("weekday_class"))
    out = demo.recommend(asked, attraction.popularity(t, ["origin_id", *attraction.CONTEXT]), scored)
    return out.withColumn("score", F.round("score", 6))


#: Ends of trips, each in a region and by chance in an area.
_ENDS = """ends AS (SELECT trip_id, CASE pickup_region WHEN 'north' THEN 'Taipei' ELSE 'Taichung' END AS pickup_region, CASE WHEN origin_id % 4 = 0 THEN 'fallback' ELSE 'density' END AS pickup_assignment, CASE WHEN d_lat < 70 THEN 'Taipei' ELSE 'Kaohsiung' END AS dropoff_region, CASE WHEN area_id % 5 = 0 THEN 'fallback' ELSE 'density' END AS dropoff_assignment FROM ok)"""


def _ends(spark, sf_dir):
    from tripforge.plans.testbed import eligible

    side = lambda c, n: F.when(F.col(c) % n == 0, "fallback").otherwise("density")
    return eligible(trips(spark, sf_dir)).select("trip_id", F.when(F.col("pickup_region") == "north", "Taipei").otherwise("Taichung").alias("pickup_region"), side("origin_id", 4).alias("pickup_assignment"), F.when(F.col("d_lat") < 70, "Taipei").otherwise("Kaohsiung").alias("dropoff_region"), side("area_id", 5).alias("dropoff_assignment"))


@query(", " + _ENDS + " SELECT side, region, count(*) AS n FROM (SELECT 'pickup' AS side, pickup_region AS region, pickup_assignment AS a FROM ends UNION ALL SELECT 'dropoff', dropoff_region, dropoff_assignment FROM ends) WHERE a = 'fallback' GROUP BY ALL")
def fallback_counts(spark, sf_dir):
    return demo.fallbacks(_ends(spark, sf_dir))


@query(", " + _ENDS + " SELECT count(*) AS trips, count(*) FILTER (dropoff_region = 'Taipei') AS in_region, count(*) FILTER (dropoff_region = 'Taipei' AND dropoff_assignment = 'density') AS verified, round((count(*) FILTER (dropoff_region = 'Taipei' AND dropoff_assignment = 'density'))::DOUBLE / count(*) FILTER (dropoff_region = 'Taipei'), 6) AS destination_coverage FROM ends")
def destination_coverage(spark, sf_dir):
    return demo.destination_coverage(_ends(spark, sf_dir)).withColumn("destination_coverage", F.round("destination_coverage", 6))


_POINTS = """pt AS (SELECT trip_id, unnest(['pickup', 'dropoff']) AS side, unnest([23.5 + p_lat::DOUBLE / 60, 23.5 + d_lat::DOUBLE / 60]) AS lat, unnest([120.5 + p_lng::DOUBLE / 60, 120.5 + d_lng::DOUBLE / 60]) AS lng FROM ok)"""


@query(", " + _POINTS + " SELECT side, CASE WHEN lat >= 24.7 AND lat <= 25.4 AND lng >= 121.2 AND lng <= 122.0 THEN 'Taipei' WHEN lat >= 23.8 AND lat < 24.7 AND lng >= 120.2 AND lng < 121.4 THEN 'Taichung' WHEN lat >= 22.4 AND lat < 23.8 AND lng >= 120.0 AND lng < 121.2 THEN 'Kaohsiung' ELSE 'Other/Unknown' END AS region, count(*) AS n, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM pt GROUP BY ALL")
def coordinate_regions(spark, sf_dir):
    """The coordinate pool by side and region."""
    from tripforge.plans.testbed import eligible

    at = lambda c, base: F.lit(base) + F.col(c) / F.lit(60.0)
    t = eligible(trips(spark, sf_dir)).select("trip_id", F.lit(None).cast("string").alias("region"), at("p_lat", 23.5).alias("pickup_lat"), at("p_lng", 120.5).alias("pickup_lng"), at("d_lat", 23.5).alias("dropoff_lat"), at("d_lng", 120.5).alias("dropoff_lng"))
    pool = area_ops.coordinate_pool(t).withColumn("region", region_bucket(F.col("lat"), F.col("lng")))
    return pool.groupBy("side", "region").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 13 >= 10 THEN 'full' WHEN c_custkey % 13 >= 3 THEN 'light' ELSE 'cold' END AS level, c_custkey % 13 AS trip_count FROM customer),
l AS (SELECT level, max(c_custkey) AS k FROM c GROUP BY level)
SELECT alias, persona, p.level AS level, CASE WHEN p.level <> 'cold' THEN printf('r%08d', k) END AS rider_key, coalesce(c.trip_count, 0) AS trip_count, p.level <> 'cold' AND k IS NOT NULL AS personal_mobility_available FROM (VALUES ('demo_rider_full', 'frequent', 'full'), ('demo_rider_light', 'occasional', 'light'), ('demo_rider_cold', 'new', 'cold')) p(alias, persona, level) LEFT JOIN l ON l.level = p.level LEFT JOIN c ON c.c_custkey = k""", view=False)
def personas(spark, sf_dir):
    """The riders that stand for the levels: the largest key of each."""
    k = F.col("c_custkey")
    n = k % 13
    profiles = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("r%08d", k).alias("rider_key"), F.when(n >= 10, "full").when(n >= 3, "light").otherwise("cold").alias("level"), n.alias("trip_count"))
    chosen = release.personas(profiles)
    known = release.profile_of_alias(chosen, profiles).select("alias", "personal_mobility_available")
    return chosen.join(known, "alias").select("alias", "persona", "level", "rider_key", "trip_count", "personal_mobility_available")


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 OR c_acctbal + 0.003::DOUBLE <= 0 THEN 8 ELSE least(10, greatest(6, 1.5 * ((c_acctbal + 0.003::DOUBLE) / 1000))) END, 3) AS budget_km FROM customer", view=False)
def distance_budgets(spark, sf_dir):
    """How far riders go, by level and median."""
    level = F.when(F.col("c_custkey") % 4 == 0, "cold").when(F.col("c_custkey") % 4 == 1, "light").otherwise("full")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", distance_budget_km(level, (F.col("c_acctbal") + 0.003) / F.lit(1000.0)).alias("budget_km"))


#: HMAC of the id under the salt "pepper": two hashes over the padded key, as bytes.
_PAD = lambda b: "".join(f"\\x{(ord(c) if c else 0) ^ b:02X}" for c in ["p", "e", "p", "p", "e", "r", *[""] * 58])


@query(f"SELECT c_custkey, 'rider_' || sha256('{_PAD(0x5C)}'::BLOB || unhex(sha256('{_PAD(0x36)}'::BLOB || encode(c_custkey::VARCHAR)))) AS rider_key FROM customer", view=False)
def rider_keys(spark, sf_dir):
    """Pseudonyms of riders."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", rider_key(F.col("c_custkey"), "pepper").alias("rider_key"))
