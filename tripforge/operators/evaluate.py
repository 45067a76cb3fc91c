"""Offline evaluation: candidate areas, six rankers, metrics, the weight grid."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from tripforge.functions.geo import ROAD_FACTOR
from tripforge.functions.scoring import clip, combine, distance_fit_batch, mobility_score, ratio
from tripforge.operators import spatial

MODELS = ("global_popularity", "origin_period", "area_a", "area_a_plus_b", "area_a_plus_c", "area_a_plus_b_plus_c")
#: Of models without questions to tune on.
DEFAULT_WEIGHTS = {"area_a_plus_c": (0.55, 0.0, 0.45), "area_a_plus_b": (0.55, 0.45, 0.0), "area_a_plus_b_plus_c": (0.4, 0.3, 0.3)}
QUESTION = ["trip_id"]


@F.pandas_udf(BooleanType())
def in_tuning_sample(trip_id: pd.Series) -> pd.Series:
    """One in eight, by a 4-byte blake2b of the id as text, which Spark has no function for;
    null for a null id."""
    chosen = lambda x: int.from_bytes(hashlib.blake2b(str(int(x)).encode(), digest_size=4).digest(), "big") % 8 == 0
    return trip_id.map(lambda x: None if pd.isna(x) else chosen(x))


def candidates(questions: DataFrame, areas: DataFrame, near: float = 20.0, far: float = 30.0, least: int = 10) -> DataFrame:
    """Questions with each area in reach: road distance within `near`, or within `far`
    where fewer than `least` are near. They are found through cells of the wider circle."""
    there = areas.select(F.col("area_id").alias("candidate"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    rows = spatial.within(questions, there, far / ROAD_FACTOR * (1 + 1e-9)).withColumn("distance", F.col("km") * ROAD_FACTOR).drop("km").where(F.col("distance") <= far)
    close = F.count_if(F.col("distance") <= near).over(Window.partitionBy(*QUESTION))
    return rows.withColumn("_close", close).where((F.col("_close") < least) | (F.col("distance") <= near)).drop("_close", "a_lat", "a_lng")


def c_scores(rows: DataFrame, profiles: DataFrame, visits: DataFrame, cohort: DataFrame) -> DataFrame:
    """Adds c_score: null for cold riders and those without a profile. visits: rider_id,
    area_id, visits over all periods."""
    of = rider_terms(profiles.where("level <> 'cold'"), visits, cohort).drop("level").withColumnRenamed("_n", "trip_count")
    rows = rows.join(of, "rider_id", "left").join(visits.select("rider_id", F.col("area_id").alias("candidate"), "visits"), ["rider_id", "candidate"], "left")
    period = F.coalesce(*[F.when(F.col("period") == p, F.col(f"{p}_ratio")) for p in ("morning", "lunch", "afternoon", "dinner", "night")])
    fit = distance_fit_batch(F.col("distance"), F.col("_25"), F.col("_75"), F.col("_90"))
    score = mobility_score(fit, period, F.col("weekend_ratio"), F.col("trip_count"), F.col("weekday_class"), F.coalesce("visits", F.lit(0)), F.coalesce("most", F.lit(0)))
    return rows.withColumn("c_score", F.when(F.col("trip_count").isNotNull(), score)).drop(*of.columns[1:], "visits")


def rider_terms(profiles: DataFrame, visits: DataFrame, cohort: DataFrame) -> DataFrame:
    """rider_id, level, and what C needs of a rider, null for cold ones: _n (trips), ratios,
    most (visits of an area) and the percentiles _25, _75 and _90."""
    light = cohort.where("level = 'light'").select(F.col("p25").alias("l25"), F.col("p75").alias("l75"), F.col("p90").alias("l90"))
    most = visits.groupBy("rider_id").agg(F.max("visits").alias("most"))
    of = profiles.join(most, "rider_id", "left").join(light, F.lit(True), "left")
    full = F.col("level") == "full"
    median = F.col("median_km")
    p25 = F.when(full, F.col("p25_km")).otherwise(F.least(median, F.coalesce("l25", median)))
    p75 = F.when(full, F.col("p75_km")).otherwise(F.greatest(median, F.coalesce("l75", median)))
    of = of.withColumn("_25", p25).withColumn("_75", p75)
    p90 = F.when(full, F.col("p90_km")).otherwise(F.greatest(F.col("_75") + 0.1, F.coalesce("l90", F.col("_75") + 0.1)))
    known = lambda x, name: F.when(F.col("level") != "cold", x).alias(name)
    kept = ["weekend_ratio", "morning_ratio", "lunch_ratio", "afternoon_ratio", "dinner_ratio", "night_ratio", "most", "_25", "_75"]
    return of.select("rider_id", "level", known(F.col("trip_count"), "_n"), *[known(F.col(x), x) for x in kept], known(p90, "_90"))


def b_scores(riders: DataFrame, neighbours: DataFrame, rider_area: DataFrame, scale: DataFrame, least: int = 5) -> DataFrame:
    """(rider_id, period, area_id, b_score) of areas that neighbours visited, for riders
    with `least` neighbours or more; b_zero is the score of all other areas."""
    near, total = _near(riders, neighbours, least)
    raw = near.join(rider_area.select(F.col("rider_id").alias("neighbour"), "area_id", "period", "visits"), "neighbour")
    raw = raw.groupBy("rider_id", "period", "area_id").agg(F.sum(F.col("similarity") * F.log1p(F.col("visits").cast("double"))).alias("s")).join(total, "rider_id")
    raw = raw.crossJoin(F.broadcast(_usable(scale)))  # one row
    return raw.select("rider_id", "period", "area_id", _scaled(F.col("s") / F.col("total")).alias("b_score"), _scaled(F.lit(0.0)).alias("b_zero"))


def _near(riders: DataFrame, neighbours: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Neighbours that count, and the riders with enough of them (rider_id, total, k)."""
    near = neighbours.join(riders.select("rider_id"), "rider_id", "left_semi").where("similarity > 0")
    total = near.groupBy("rider_id").agg(F.sum("similarity").alias("total"), F.count(F.lit(1)).alias("k")).where((F.col("k") >= least) & (F.col("total") > 0))
    return near, total


def _usable(scale: DataFrame) -> DataFrame:
    return scale.where(F.abs(F.col("p95") - F.col("p5")) > 1e-12)


def _scaled(x):
    return clip(F.try_divide(x - F.col("p5"), F.col("p95") - F.col("p5")))


def b_zero(riders: DataFrame, neighbours: DataFrame, scale: DataFrame, least: int = 5) -> DataFrame:
    """(rider_id, b_zero) of riders with enough neighbours: the score of areas that no
    neighbour visited."""
    return _near(riders, neighbours, least)[1].crossJoin(F.broadcast(_usable(scale))).select("rider_id", _scaled(F.lit(0.0)).alias("b_zero"))


def with_b(rows: DataFrame, riders: DataFrame, neighbours: DataFrame, rider_area: DataFrame, scale: DataFrame, least: int = 5) -> DataFrame:
    """Adds b_score to rows (rider_id, period, candidate): b_zero for areas that no
    neighbour visited in the period, null for riders without enough neighbours."""
    zero = b_zero(riders, neighbours, scale, least).withColumnRenamed("b_zero", "_zero")
    seen = b_scores(riders, neighbours, rider_area, scale, least).select("rider_id", "period", F.col("area_id").alias("candidate"), F.col("b_score").alias("_seen"))
    rows = rows.join(zero, "rider_id", "left").join(seen, ["rider_id", "period", "candidate"], "left")
    return rows.withColumn("b_score", F.coalesce("_seen", "_zero")).drop("_seen", "_zero")


def long_scores(rows: DataFrame, weights: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Six score columns in long form: (.., model, score). rows: global_score,
    origin_score, a_score, b_score, c_score."""
    score = model_scores(weights)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in score.items()]))
    keep = [x for x in rows.columns if x not in ("global_score", "origin_score", "a_score", "b_score", "c_score")]
    return rows.select(*keep, pairs.alias("p")).select(*keep, "p.*")


def ranked(scores: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """position: 1 for the highest score; ties by area."""
    s = F.col("score") if digits is None else F.round("score", digits)
    return scores.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(s), "candidate")))


def outcomes(positions: DataFrame, groups: list[str]) -> DataFrame:
    """positions: trip_id, model, candidate, distance, position, actual (null where the
    destination is in no area), and the columns of groups. A row per question and model:
    verified, covered, at (position of the destination), km, items, shown (the top five)."""
    hit = F.col("candidate") == F.col("actual")
    top = F.col("position") <= 5
    return positions.groupBy("trip_id", "model", *groups).agg(
        F.max(F.col("actual").isNotNull()).alias("verified"), F.max(F.coalesce(hit, F.lit(False))).alias("covered"), F.max(F.when(hit, F.col("position"))).alias("at"),
        F.sum(F.when(top, F.col("distance"))).alias("km"), F.count_if(top).alias("items"), F.collect_list(F.when(top, F.col("candidate"))).alias("shown"),
    )


def model_scores(weights: dict[str, tuple[float, float, float]], of=F.col) -> dict:
    """The score of each model, from global_score, origin_score, a_score, b_score, c_score."""
    a, b, c = of("a_score"), of("b_score"), of("c_score")
    score = {"global_popularity": of("global_score").cast("double"), "origin_period": of("origin_score").cast("double"), "area_a": a}
    return score | {m: clip(combine((w[0], a), (w[1], F.when(F.lit(w[1] > 0), b)), (w[2], F.when(F.lit(w[2] > 0), c)))) for m, w in weights.items()}


def outcomes_of_scores(rows: DataFrame, weights: dict[str, tuple[float, float, float]], groups: list[str], digits: int) -> DataFrame:
    """The same from rows of scores (as for `long_scores`), without a row per model: all
    models rank the candidates of a question after one shuffle by question."""
    score = model_scores(weights)
    rows = rows.select("trip_id", "actual", *groups, "candidate", "distance", *[F.round(s, digits).alias(f"_s_{m}") for m, s in score.items()])
    for m in score:
        rows = rows.withColumn(f"_at_{m}", F.row_number().over(Window.partitionBy("trip_id").orderBy(F.desc(f"_s_{m}"), "candidate"))).drop(f"_s_{m}")
    hit = F.col("candidate") == F.col("actual")
    top = lambda m: F.col(f"_at_{m}") <= 5
    per = rows.groupBy("trip_id", *groups).agg(
        F.max(F.col("actual").isNotNull()).alias("verified"), F.max(F.coalesce(hit, F.lit(False))).alias("covered"),
        *[x.alias(f"{k}_{m}") for m in score for k, x in (("at", F.max(F.when(hit, F.col(f"_at_{m}")))), ("km", F.sum(F.when(top(m), F.col("distance")))), ("items", F.count_if(top(m))), ("shown", F.collect_list(F.when(top(m), F.col("candidate")))))],
    )
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"{k}_{m}").alias(k) for k in ("at", "km", "items", "shown")]) for m in score]))
    return per.select("trip_id", *groups, "verified", "covered", models.alias("m")).select("trip_id", *groups, "verified", "covered", "m.*")


def metrics(positions: DataFrame, total_areas: int, groups: list[str]) -> DataFrame:
    """As `summary`, from ranked candidates."""
    return summary(outcomes(positions, groups), total_areas, groups)


def summary(per: DataFrame, total_areas: int, groups: list[str]) -> DataFrame:
    """per: outcomes (read twice, so better stored). A row per model, and per model and
    value of each group."""
    keys = [F.col(g) for g in groups]
    sets = [[F.col("model")], *[[F.col("model"), k] for k in keys]]
    name = F.coalesce(*[F.when(F.grouping(g) == 0, F.lit(g)) for g in groups], F.lit("overall"))
    value = F.coalesce(*[F.when(F.grouping(g) == 0, k.cast("string")) for g, k in zip(groups, keys)], F.lit("all"))
    n = F.count_if("verified")
    found = per.groupingSets(sets, F.col("model"), *keys).agg(
        name.alias("grouping"), value.alias("value"), F.count(F.lit(1)).alias("questions"), n.alias("verified"), ratio(n, F.count(F.lit(1))).alias("destination_coverage"),
        ratio(F.count_if("covered"), n).alias("candidate_coverage"), ratio(F.count_if(F.col("at") <= 5), n).alias("hit5"), ratio(F.count_if(F.col("at") <= 10), n).alias("hit10"),
        ratio(F.sum(F.when(F.col("at") <= 5, F.lit(1.0) / F.col("at"))), n).alias("mrr5"), ratio(F.sum(F.when(F.col("at") <= 5, F.lit(1.0) / F.log2(F.col("at") + F.lit(1.0)))), n).alias("ndcg5"),
        ratio(F.sum("km"), F.sum("items")).alias("mean_km"), F.sum("items").alias("items"),
    ).drop(*groups)
    shown = per.select("model", *groups, F.explode("shown").alias("candidate")).groupingSets([[F.col("model"), F.col("candidate")], *[[F.col("model"), F.col("candidate"), k] for k in keys]], F.col("model"), F.col("candidate"), *keys)
    shown = shown.agg(name.alias("grouping"), value.alias("value"), F.count(F.lit(1)).alias("n"))
    shown = shown.groupBy("model", "grouping", "value").agg(F.count(F.lit(1)).alias("shown"), F.max("n").alias("most"))
    return found.join(shown, ["model", "grouping", "value"], "left").select(
        "model", "grouping", "value", "questions", "verified", "destination_coverage", "candidate_coverage", "hit5", "hit10", "mrr5", "ndcg5",
        ratio(F.col("shown"), F.lit(total_areas)).alias("catalog_coverage"), "mean_km", ratio(F.col("most"), F.col("items")).alias("concentration"),
    )


def summary_of_sums(sums: DataFrame, shown: DataFrame, total_areas: int, groups: list[str]) -> DataFrame:
    """As `summary`, from sums of questions and counts of candidates among the first five, by
    model and all groups (`questions.outcome_sums`)."""
    keys = [F.col(g) for g in groups]
    sets = [[F.col("model")], *[[F.col("model"), k] for k in keys]]
    name = F.coalesce(*[F.when(F.grouping(g) == 0, F.lit(g)) for g in groups], F.lit("overall"))
    value = F.coalesce(*[F.when(F.grouping(g) == 0, k.cast("string")) for g, k in zip(groups, keys)], F.lit("all"))
    n = F.sum("verified")
    found = sums.groupingSets(sets, F.col("model"), *keys).agg(
        name.alias("grouping"), value.alias("value"), F.sum("questions").cast("long").alias("questions"), n.cast("long").alias("verified"), ratio(n, F.sum("questions")).alias("destination_coverage"),
        ratio(F.sum("covered"), n).alias("candidate_coverage"), *[ratio(F.sum(x), n).alias(x) for x in ("hit5", "hit10", "mrr5", "ndcg5")], ratio(F.sum("km"), F.sum("items")).alias("mean_km"), F.sum("items").alias("items"),
    ).drop(*groups)
    most = shown.groupingSets([[F.col("model"), F.col("candidate")], *[[F.col("model"), F.col("candidate"), k] for k in keys]], F.col("model"), F.col("candidate"), *keys)
    most = most.agg(name.alias("grouping"), value.alias("value"), F.sum("n").alias("n"))
    most = most.groupBy("model", "grouping", "value").agg(F.count(F.lit(1)).alias("shown"), F.max("n").alias("most"))
    return found.join(most, ["model", "grouping", "value"], "left").select(
        "model", "grouping", "value", "questions", "verified", "destination_coverage", "candidate_coverage", "hit5", "hit10", "mrr5", "ndcg5",
        ratio(F.col("shown"), F.lit(total_areas)).alias("catalog_coverage"), "mean_km", ratio(F.col("most"), F.col("items")).alias("concentration"),
    )


def weight_grid() -> list[tuple[str, float, float, float]]:
    """(model, a, b, c) in tenths: a from 0.3 to 0.9 against b or c; all with a of 0.3 or more."""
    two = [x / 10 for x in range(3, 10)]
    three = [("area_a_plus_b_plus_c", a / 10, b / 10, (10 - a - b) / 10) for a in range(3, 9) for b in range(1, 10 - a) if 10 - a - b >= 1]
    return [("area_a_plus_c", a, 0.0, round(1 - a, 1)) for a in two] + [("area_a_plus_b", a, round(1 - a, 1), 0.0) for a in two] + three


def tune(rows: DataFrame, strict: bool = False, digits: int | None = None) -> DataFrame:
    """rows: trip_id, candidate, actual, a_score, b_score, c_score -> a row per model and
    weights, best first (rank 1). Questions without a component don't count for models
    that need it. No candidates are sorted: a position is one more than the number of those
    ahead of the true area. Where the true area isn't a candidate, its position is after the last:
    a hit if there are fewer than five candidates, unless strict."""
    whole, names = Window.partitionBy("trip_id"), ("a_score", "b_score", "c_score")
    rows = rows.select("trip_id", "actual", "candidate", *names, *[F.max(F.when(F.col("candidate") == F.col("actual"), F.col(x))).over(whole).alias(f"_{x}") for x in names])

    def better(a: float, b: float, c: float):
        """(usable, ahead of the destination) for one weighting."""
        parts = [(w, x) for w, x in zip((a, b, c), names) if w]
        of = lambda prefix: clip(sum((F.lit(w) * F.col(prefix + x) for w, x in parts[1:]), F.lit(parts[0][0]) * F.col(prefix + parts[0][1])))
        mine, its = (of(p) if digits is None else F.round(of(p), digits) for p in ("", "_"))
        return mine.isNotNull(), (mine > its) | ((mine == its) & (F.col("candidate") < F.col("actual"))), its.isNotNull()

    grid = [(m, a, b, c, *better(a, b, c)) for m, a, b, c in weight_grid()]
    per = rows.groupBy("trip_id").agg(*[x.alias(f"{k}{i}") for i, (*_, usable, ahead, there) in enumerate(grid) for k, x in (("n", F.count_if(usable)), ("ahead", F.count_if(ahead)), ("there", F.max(there)))])
    place = lambda i: F.when(F.col(f"there{i}"), F.col(f"ahead{i}") + 1).otherwise(F.lit(None) if strict else F.col(f"n{i}") + 1)
    each = [F.when(F.col(f"n{i}") > 0, F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), place(i).alias("at"))) for i, (m, a, b, c, *_) in enumerate(grid)]
    per = per.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")  # 35 rows a question
    found = per.groupBy("model", "a", "b", "c").agg(F.count(F.lit(1)).alias("questions"), F.avg(F.when(F.col("at") <= 5, 1.0).otherwise(0.0)).alias("hit5"), F.avg(F.when(F.col("at") <= 5, F.lit(1.0) / F.col("at")).otherwise(0.0)).alias("mrr5"))
    return best_weights(found)


def best_weights(found: DataFrame) -> DataFrame:
    """model, a, b, c, questions, hit5, mrr5 -> by label, best first (rank 1)."""
    label = F.format_string("%.1f/%.1f/%.1f", "a", "b", "c")
    w = Window.partitionBy("model").orderBy(F.desc(F.round("hit5", 12)), F.desc(F.round("mrr5", 12)), F.desc("a"), "weights")
    return found.select("model", label.alias("weights"), "a", "questions", "hit5", "mrr5").withColumn("rank", F.row_number().over(w)).drop("a")
