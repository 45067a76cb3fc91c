"""Exact quantiles of large groups, by selection instead of a group in one task.

`percentile` keeps a group's distinct values together in its last task. Here a quantile is
first bracketed by approximate quantiles, whose rank error has a bound, a little below and
a little above it. One pass counts what is below each bracket and what is in it; another
adds up equal values within. The two order statistics around the quantile then stand at
known places among the values of its bracket: a share of about 5 / ACCURACY of the group,
and fewer rows where values repeat. Brackets are checked against the counts: one that misses
its quantile is widened to all values.

Interpolation is linear between order statistics, as `percentile` and SQL's
`percentile_cont` have it. Nulls don't count; a group of nulls only has null quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripforge.sources.scratch import stored

ACCURACY = 10_000
#: Groups of up to so many values are sorted by `percentile`, in a task.
LARGE = 1 << 20


def quantiles(rows: DataFrame, by: list[str], value: str, qs: list[float], large: int = LARGE, accuracy: int = ACCURACY) -> DataFrame:
    """A row for each group (by; none for all rows): by, n (values that aren't null) and q,
    an array of the exact quantiles. Groups of more than `large` values are selected from."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    data = stored(rows.select(group.alias("_g"), F.col(value).cast("double").alias("_v")), "values")
    big = stored(data.groupBy("_g").agg(F.count("_v").alias("n")).where(F.col("n") > large).select("_g"), "large")
    if big.isEmpty():
        out = _sorted(data, qs)
    else:
        out = _sorted(data.join(big, "_g", "left_anti"), qs).unionByName(_selected(data.join(big, "_g", "left_semi"), qs, accuracy))
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in by], "n", "q")


def _sorted(data: DataFrame, qs: list[float]) -> DataFrame:
    some = F.expr(f"percentile(_v, array({', '.join(f'{q!r}D' for q in map(float, qs))}))")
    none = F.array_repeat(F.lit(None).cast("double"), len(qs))
    return data.groupBy("_g").agg(F.count("_v").alias("n"), F.coalesce(some, none).alias("q"))


def _selected(data: DataFrame, qs: list[float], accuracy: int) -> DataFrame:
    eps = 2.0 / accuracy
    ends = [(max(0.0, q - eps), min(1.0, q + eps)) for q in qs]
    every = sorted({x for pair in ends for x in pair})
    told = lambda x: F.col("_told")[every.index(x)]
    lowest, highest = F.lit(float("-inf")), F.lit(float("nan"))  # NaN is above all numbers
    bracket = [F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("p"), (told(lo) if lo else lowest).alias("lo"), (told(hi) if hi < 1 else highest).alias("hi")) for i, (q, (lo, hi)) in enumerate(zip(qs, ends, strict=True))]
    head = data.groupBy("_g").agg(F.count("_v").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, every)), F.lit(accuracy)).alias("_told"))
    head = stored(head.select("_g", "n", F.array(*bracket).alias("_b")), "brackets")  # a row for each group

    data = data.where("_v IS NOT NULL")
    b = lambda i: F.col("_b")[i]
    counts = [x for i in range(len(qs)) for x in (F.count_if(F.col("_v") < b(i)["lo"]).alias(f"below{i}"), F.count_if(F.col("_v").between(b(i)["lo"], b(i)["hi"])).alias(f"inside{i}"))]
    seen = data.join(head, "_g").groupBy("_g").agg(*counts)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"below{i}").alias("below"), F.col(f"inside{i}").alias("inside")) for i in range(len(qs))]))
    seen = seen.select("_g", sides.alias("s")).select("_g", "s.*")
    plan = head.select("_g", "n", F.explode("_b").alias("b")).select("_g", "n", "b.*").join(seen, ["_g", "i"])
    at = F.col("p") * (F.col("n") - 1)
    hit = (F.col("below") <= F.floor(at)) & (F.ceil(at) < F.col("below") + F.col("inside"))
    plan = plan.withColumns({"lo": F.when(hit, F.col("lo")).otherwise(lowest), "hi": F.when(hit, F.col("hi")).otherwise(highest), "below": F.when(hit, F.col("below")).otherwise(0)})
    plan = stored(plan.drop("inside"), "places")  # a row for each group and quantile

    within = data.join(plan, "_g").where(F.col("_v").between(F.col("lo"), F.col("hi")))
    within = within.groupBy("_g", "i", "n", "p", "below", "_v").agg(F.count(F.lit(1)).alias("c"))
    # the value at a place is the first that the running count reaches it with
    order = Window.partitionBy("_g", "i").orderBy("_v")
    within = within.withColumn("_upto", F.col("below") + F.sum("c").over(order))
    pick = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    found = within.groupBy("_g", "i", "n", "p").agg(pick(F.floor(at)).alias("a"), pick(F.ceil(at)).alias("b"))
    part = at - F.floor(at)
    found = found.withColumn("x", F.when(part == 0, F.col("a")).otherwise((1.0 - part) * F.col("a") + part * F.col("b")))
    found = found.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
    none = F.array_repeat(F.lit(None).cast("double"), len(qs))
    return head.join(found, "_g", "left").select("_g", "n", F.coalesce("q", none).alias("q"))
