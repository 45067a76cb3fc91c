"""Attraction of areas by context, and popularity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tripforge.functions.calendar import PERIODS, WEEKDAY_CLASSES
from tripforge.functions.scoring import A_WEIGHTS, ratio, robust_minmax
from tripforge.operators.quantiles import quantiles

CONTEXT = ["period", "weekday_class"]


def contexts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, w) for p in PERIODS for w in WEEKDAY_CLASSES], "period string, weekday_class string")


def context_counts(trips: DataFrame) -> DataFrame:
    """Visits of each area by context, and the days that have some."""
    return trips.groupBy("area_id", *CONTEXT).agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("day").alias("days"))


def source_entropy(trips: DataFrame) -> DataFrame:
    """By destination: trips of known origin, share from other areas, entropy of the
    origins over the log of their number (0 for less than two)."""
    by = trips.where("origin_id is not null").groupBy("area_id", "origin_id").agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy("area_id").agg(
        F.sum("n").alias("known"), F.sum(F.when(F.col("origin_id") != F.col("area_id"), F.col("n")).otherwise(0)).alias("crossing"),
        F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("nln"),
    )
    # -sum(p ln p) = ln N - sum(n ln n) / N
    entropy = F.ln(F.col("known").cast("double")) - F.col("nln") / F.col("known")
    return total.select("area_id", "known", ratio(F.col("crossing"), F.col("known")).alias("cross_area_ratio"), F.when(F.col("k") > 1, F.try_divide(entropy, F.ln(F.col("k").cast("double")))).otherwise(0.0).alias("source_diversity"))


def return_rate(trips: DataFrame) -> DataFrame:
    """Riders of an area, those with two visits or more, and their share."""
    visits = trips.groupBy("area_id", "rider_id").agg(F.count(F.lit(1)).alias("n"))
    return visits.groupBy("area_id").agg(F.count(F.lit(1)).alias("riders"), F.count_if(F.col("n") >= 2).alias("repeaters")).withColumn("return_rate", ratio(F.col("repeaters"), F.col("riders")))


def area_grid(trips: DataFrame, areas: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Raw metrics on the dense grid of areas and contexts. trips: all destinations of the
    training split, with a null area_id where none is assigned; totals by context count
    those too, totals by area don't."""
    spark = trips.sparkSession
    known = trips.where("area_id is not null")
    grid = areas.select("area_id").crossJoin(F.broadcast(contexts(spark)))  # 10 contexts
    of_context = trips.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("context_total"))
    of_area = known.groupBy("area_id").agg(F.count(F.lit(1)).alias("area_total"))
    overall = trips.agg(F.countDistinct("day").alias("train_days"), F.count("area_id").alias("total")).crossJoin(areas.agg(F.count(F.lit(1)).alias("n_areas")))
    rows = grid.join(context_counts(known), ["area_id", *CONTEXT], "left").join(of_context, CONTEXT, "left").join(of_area, "area_id", "left")
    rows = rows.join(source_entropy(known), "area_id", "left").join(return_rate(known), "area_id", "left").crossJoin(F.broadcast(overall)).fillna(0)  # one row
    of = lambda n, total: F.greatest((n + F.lit(alpha)) / (total + F.lit(alpha) * F.col("n_areas")), F.lit(1e-12))
    return rows.select(
        "area_id", *CONTEXT, "visits", "days", "riders", "repeaters", F.log1p(F.col("visits") / F.greatest("train_days", F.lit(1))).alias("visit_heat"),
        F.ln(of(F.col("visits"), F.col("context_total")) / of(F.col("area_total"), F.col("total"))).alias("period_lift"), "cross_area_ratio", "source_diversity", "return_rate",
    )


def area_attraction(grid: DataFrame) -> DataFrame:
    """Scales each metric between its 5th and 95th percentile over the grid (area metrics
    count once per context there) and weights them."""
    long = grid.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in A_WEIGHTS])).alias("x")).select("x.*")
    scale = quantiles(long, ["m"], "v", [0.05, 0.95]).agg(*[F.max(F.when(F.col("m") == m, F.col("q"))).alias(f"_{m}") for m in A_WEIGHTS])
    rows = grid.crossJoin(F.broadcast(scale))  # one row
    part = {m: robust_minmax(F.col(m), F.col(f"_{m}")[0], F.col(f"_{m}")[1]) for m in A_WEIGHTS}
    score = sum((F.lit(w) * part[m] for m, w in A_WEIGHTS.items()), F.lit(0.0))
    return rows.select("area_id", *CONTEXT, "visits", "days", "riders", "repeaters", F.round(score, 12).alias("area_score"), *[F.round(part[m], 12).alias(m) for m in A_WEIGHTS])


def popularity(trips: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Counts of areas within each group, ranked by count, then id."""
    counts = trips.where("area_id is not null").groupBy(*by, "area_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "area_id")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def rank_areas(scored: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """Areas by score, visits, id."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("area_score", 12)), F.desc("visits"), "area_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
