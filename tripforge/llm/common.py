"""What the text operators share: the shared folder, stored row numbers, skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.sources.scratch import cleanup, delete, fresh_dir, shared_dir, work_dir  # noqa: F401  (for callers)

#: Keys that `lookup` treats as hot. It broadcasts exactly this many rows at most.
HOT_KEYS = 256
#: Ways in which the rows of a hot key are dealt out.
SALTS = 1024
WHITE = r"[\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables of one call. Tables that nothing reads any more are
    dropped at once, which keeps the disk in proportion to the input."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """Writes a table to the shared folder and reads it again; this cuts the lineage."""
        path = fresh_dir(self.spark, f"{self.name}-{what}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[what] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, what: str) -> None:
        delete(self.spark, self.paths.pop(what))


def tune(spark: SparkSession) -> None:
    """Arrow batches of a bounded size, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with more underscores if df has a column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def numbered(keep: Scratch, df: DataFrame, name: str = "_uid") -> DataFrame:
    """The rows with a number each, which tells repeated rows with equal or null ids apart.
    They are written once and read from there: a number that was computed again could be
    another one, as the splits of a scan follow the number of cores that are alive."""
    return keep.write(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, k: int):
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % k


def lookup(rows: DataFrame, summary: DataFrame, key: str, values: list[str], size: str) -> DataFrame:
    """Left join of rows to one summary row per key, where a few keys may hold most
    rows. The HOT_KEYS largest keys (by `size`) reach the rows by a broadcast of just
    as many rows; every other key has less than 1/HOT_KEYS of all rows and is joined
    by shuffle. Rows of hot keys are salted, so that they don't meet in a task.
    rows needs _uid."""
    hot = summary.orderBy(F.desc(size), key).limit(HOT_KEYS)
    hot = hot.select(key, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), 1 + F.pmod("_uid", F.lit(SALTS))).otherwise(0)
    )
    found = dealt.join(summary.select(key, *values).withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    for v in values:
        found = found.withColumn(v, F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(v)))
    return found.drop("_hot", "_salt", *[f"_hot_{v}" for v in values])
