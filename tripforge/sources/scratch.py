"""Tables that a query reads several times, stored once in the folder that the cluster
shares. Lost executors cost nothing then, and each later read prunes its columns."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


#: The shuffle files of a write go with its end, not when the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and all runs in one process (tests), a temporary folder that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept, sc = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext
        if not kept.isDefined() and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = kept.get() if kept.isDefined() else "file://" + tempfile.mkdtemp(prefix="tripforge-")
        if not kept.isDefined():
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application inside the shared one; `cleanup` deletes it."""
    return f"{shared_dir(spark)}/tripforge-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application. Results that still
    read them can't be computed afterwards."""
    delete(spark, work_dir(spark))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    path, conf = fresh_dir(df.sparkSession, name), df.sparkSession.conf
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHUFFLES_GO)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_all(tables: dict[str, DataFrame], at_once: int = 4) -> dict[str, DataFrame]:
    """Several tables that don't depend on each other, stored side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(tables, pool.map(lambda item: stored(item[1], item[0]), tables.items()), strict=True))
