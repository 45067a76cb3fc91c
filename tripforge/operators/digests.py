"""A digest of a table in its order, the same however its rows lie in partitions.

Rows are put in a total order by range partitioning (ties by the rows' own digests), and
each gets its place from its partition's offset. Digests of FAN neighbours at a time are
hashed together, and the results likewise, up to a single one: a tree of SHA-256, each
level a group of at most FAN short rows. Numbers with a fraction are told at eight decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripforge.sources.scratch import stored

FAN = 4096


def row_text(df: DataFrame) -> Column:
    """name=value of all columns by name; a null has no equals sign. Only plain values."""
    told = lambda c, t: F.format_string("%.8f", F.col(c).cast("double")) if t in ("double", "float") else F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.lit(f"{c}="), told(c, t)), F.lit(c)) for c, t in sorted(df.dtypes)]
    return F.concat_ws("\x1f", *parts)


def placed(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """h (the digest of each row) and place (from 0) in the order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], F.sha2(row_text(df), 256).alias("h"))
    rows = stored(rows.repartitionByRange(n, *keys, "h").withColumn("_part", F.spark_partition_id()), "ordered")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("_part", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("_before")), "offsets")  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*keys, "h"))
    return rows.join(F.broadcast(offsets), "_part").select("h", (rank - 1 + F.col("_before")).alias("place"))


def ordered_digest(df: DataFrame, order: list[str], fan: int = FAN, partitions: int | None = None) -> DataFrame:
    """One row: n_rows and digest. The digest of no rows is that of the empty text."""
    level = stored(placed(df, order, partitions), "places")
    count = n = level.count()
    if not n:
        return level.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.lit(""), 256).alias("digest"))
    while True:
        group = F.floor(F.col("place") / fan)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"])
        level = level.groupBy(group.alias("place")).agg(F.sha2(F.array_join(listed, ","), 256).alias("h"))
        n = -(-n // fan)
        if n == 1:
            return level.select(F.lit(count).cast("long").alias("n_rows"), F.col("h").alias("digest"))
        level = stored(level, "level")
