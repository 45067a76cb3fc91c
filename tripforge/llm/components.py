"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate (minimum neighbour of each node), stored, and a join back, so
a hub with very many neighbours is pre-aggregated and its rows are split by adaptive
execution; no task or driver holds a component. The number of rounds grows with the
logarithm of the longest path. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tripforge.llm.common import Scratch


def _observed(keep: Scratch, edges: DataFrame, what: str) -> tuple[DataFrame, tuple]:
    """Stores edges; with their number and a sum of hashes, taken on the way."""
    mark = Observation()
    edges = keep.write(edges.observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), what)
    return edges, (mark.get["n"], mark.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """edges u, v (long) -> node, root: the smallest node of each component."""
    keep = Scratch(edges.sparkSession, "components")
    down = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, mark = _observed(keep, down(edges).distinct(), "0")
    before, step = None, 0
    while mark != before and mark[0]:
        before, step = mark, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbours are tables of their own, so that a join with them can be split
        low = keep.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{step}-low")
        large = keep.write(down(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), f"{step}-large")
        keep.drop(f"{step}-low")
        low = keep.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{step}-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now, mark = _observed(keep, small.where("u <> v").distinct(), str(step))
        for what in (f"{step}-low", f"{step}-large", str(step - 1)):
            keep.drop(what)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
