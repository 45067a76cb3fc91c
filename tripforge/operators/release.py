"""Versioned serving tables, personas and releases, kept as Parquet by model_version.

A load or a batch of online rows covers several tables. Each of its tables is written to a
folder of its own, which nothing reads yet; one row, appended last, names these folders and
makes all of them visible at once. No folder is ever written again, so a writer that stops
anywhere leaves readers with what they had, and what it left behind is never read. A load
of a version that exists already only fills in what is null, as a new set of folders.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PERSONAS = (("demo_rider_full", "frequent", "full"), ("demo_rider_light", "occasional", "light"), ("demo_rider_cold", "new", "cold"))
RELEASES = "model_version string, report_hash string, loaded_at timestamp, scope string, selected_model string, serving_config_json string, folders map<string,string>"
BATCHES = "batch string, folders map<string,string>, at timestamp"


class ServiceError(Exception):
    """code: a short name of what is wrong; retryable: whether trying again may help."""

    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.code, self.retryable = code, retryable


def version_of(report_hash: str, prefix: str = "trip-serving-v1-") -> str:
    if len(report_hash) < 16:
        raise ServiceError("INVALID_REPORT", "the report hash is too short")
    return prefix + report_hash[:16]


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(existing.select(*keys), keys, "left_anti")


def filled(existing: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Existing rows, in which nulls of `columns` come from new rows."""
    news = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = existing.join(news, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_new_{c}"))
    return out.select(*existing.columns)


def personas(profiles: DataFrame) -> DataFrame:
    """profiles: rider_key, level, trip_count -> alias, persona, level, rider_key, trip_count:
    the largest key of each level; the new rider has none."""
    best = profiles.groupBy("level").agg(F.max(F.struct("rider_key", "trip_count")).alias("x"))
    names = profiles.sparkSession.createDataFrame(list(PERSONAS), "alias string, persona string, level string")
    key = F.when(F.col("level") != "cold", F.col("x.rider_key"))
    return names.join(best, "level", "left").select("alias", "persona", "level", key.alias("rider_key"), F.coalesce("x.trip_count", F.lit(0)).alias("trip_count"))


def profile_of_alias(chosen: DataFrame, profiles: DataFrame) -> DataFrame:
    """`personas` with what is known of each: personal_mobility_available where its rider
    has a profile and isn't cold; scores by similar riders aren't served."""
    have = profiles.select("rider_key").distinct().withColumn("_has", F.lit(True))
    rows = chosen.join(have, "rider_key", "left")
    known = F.coalesce("_has", F.lit(False)) & (F.col("level") != "cold")
    return rows.select("alias", "persona", "trip_count", "level", known.alias("personal_mobility_available"), F.lit(False).alias("similar_riders_available"))


def latest(releases: DataFrame) -> DataFrame:
    return releases.orderBy(F.desc("loaded_at"), F.desc("model_version")).limit(1)


def report_digest(report: dict) -> str:
    """SHA-256 of a report without its own hash, as JSON with sorted keys and no spaces."""
    rest = {k: v for k, v in report.items() if k != "report_hash"}
    return hashlib.sha256(json.dumps(rest, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def checked(report: dict, scope: str, model: str = "area_a_plus_c", fares: dict | None = None) -> str:
    """The hash of an evaluation report that may be loaded: of the right scope, with the
    right model selected, unchanged since it was hashed; fares, if given, of training data."""
    if report.get("scope") != scope:
        raise ServiceError("WRONG_SCOPE", f"the report's scope is {report.get('scope')!r}, not {scope!r}")
    if report.get("locked_config", {}).get("selected_model") != model:
        raise ServiceError("WRONG_MODEL", f"the report doesn't select {model}")
    if (found := str(report.get("report_hash"))) != report_digest(report):
        raise ServiceError("WRONG_HASH", "the report was changed after it was hashed")
    if fares is not None and (fares.get("artifact_type"), fares.get("split")) != ("train_fare_estimates", "train"):
        raise ServiceError("WRONG_FARES", "fares must be of training data")
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def releases(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each version."""
    path = f"{root}/model_releases"
    rows = spark.read.schema(RELEASES).parquet(path) if _exists(spark, path) else spark.createDataFrame([], RELEASES)
    last = rows.groupBy("model_version").agg(F.max_by(F.struct(*rows.columns), "loaded_at").alias("x"), F.min("loaded_at").alias("first"))
    return last.select("x.*").drop("loaded_at").join(last.select("model_version", F.col("first").alias("loaded_at")), "model_version").select(*rows.columns)


def _staged(df: DataFrame, root: str, name: str, part: str) -> str:
    """Writes a table to a folder that is new; gives its path below root."""
    folder = f"{name}/{part}/load={uuid.uuid4().hex[:16]}"
    df.write.option("compression", "zstd").parquet(f"{root}/{folder}")
    return folder


def load(spark: SparkSession, root: str, version: str, report_hash: str, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, scope: str | None = None, selected_model: str | None = None, config: dict | None = None) -> bool:
    """Writes each table to a new folder and then the release row; True if the version is
    new. If it is there already, nulls in its tables that have keys are filled from the new
    rows, tables that it lacks are added, and the load returns False. `load_report` checks
    the report first."""
    known = releases(spark, root).where(F.col("model_version") == version).first()
    folders = dict(known.folders) if known else {}
    for name, df in tables.items():
        own = (keys or {}).get(name)
        if name in folders:
            if not own:
                continue
            df = filled(spark.read.parquet(f"{root}/{folders[name]}"), df, own, [c for c in df.columns if c not in own])
        folders[name] = _staged(df, root, name, f"model_version={version}")
    if known and folders == dict(known.folders):
        return False
    told = (known.serving_config_json if known else None) or (json.dumps(config, sort_keys=True) if config else None)
    row = (version, report_hash, known.scope if known else scope, known.selected_model if known else selected_model, told, folders)
    rows = spark.createDataFrame([row], "model_version string, report_hash string, scope string, selected_model string, serving_config_json string, folders map<string,string>")
    rows = rows.withColumn("loaded_at", F.current_timestamp()).select(*[x.split()[0] for x in RELEASES.split(", ")])
    rows.coalesce(1).write.mode("append").parquet(f"{root}/model_releases")
    return not known


def load_report(spark: SparkSession, root: str, report: dict, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, scope: str = "demo", model: str = "area_a_plus_c", fares: dict | None = None, cohort: dict | None = None) -> tuple[str, bool]:
    """`load` of what a report was made of, once it is checked: (version, whether it is new)."""
    found = checked(report, scope, model, fares)
    config = {"weights": report["locked_config"].get("weights", {}).get(model), "cohort_distance_reference": cohort}
    version = version_of(found)
    return version, load(spark, root, version, found, tables, keys, scope, model, config)


def read(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """A table of a version, as its release row names it."""
    known = releases(spark, root).where(F.col("model_version") == version).first()
    if known is None or name not in known.folders:
        raise ServiceError("RELEASE_NOT_FOUND", f"no table {name} of {version}")
    return spark.read.parquet(f"{root}/{known.folders[name]}").withColumn("model_version", F.lit(version))


def append(spark: SparkSession, root: str, tables: dict[str, DataFrame], batch: str | None = None) -> bool:
    """Adds rows to several online tables at once; False, and nothing is added, if a batch
    of that name is there already (a retry)."""
    batch, path = batch or uuid.uuid4().hex, f"{root}/batches"
    if _exists(spark, path) and not spark.read.schema(BATCHES).parquet(path).where(F.col("batch") == batch).isEmpty():
        return False
    folders = {name: _staged(df, root, name, f"batch={batch}") for name, df in tables.items()}
    row = spark.createDataFrame([(batch, folders)], "batch string, folders map<string,string>")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return True


def appended(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of an online table whose batches are complete."""
    path = f"{root}/batches"
    done = [r.f for r in spark.read.schema(BATCHES).parquet(path).select(F.col("folders")[name].alias("f")).where("f IS NOT NULL").collect()] if _exists(spark, path) else []
    # a path for each batch of requests
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in done]) if done else spark.createDataFrame([], schema)


def select_model(metrics: list[dict]) -> dict:
    """metrics: model, hit5, mrr5 of the validation split -> the model to serve: highest
    hit rate, then reciprocal rank, then the simpler one. Neighbour scores are only in the
    race if they help the full combination."""
    of = {m["model"]: m for m in metrics}
    order = [m for m in ("global_popularity", "origin_period", "area_a", "area_a_plus_b", "area_a_plus_c", "area_a_plus_b_plus_c") if m in of]
    with_b, without = of.get("area_a_plus_b_plus_c"), of["area_a_plus_c"]
    b_helps = with_b is not None and (with_b["hit5"] - without["hit5"] > 1e-12 or (abs(with_b["hit5"] - without["hit5"]) <= 1e-12 and with_b["mrr5"] > without["mrr5"]))
    names = order if b_helps else [m for m in order if "_b" not in m]
    best = min(names, key=lambda m: (-of[m]["hit5"], -of[m]["mrr5"], order.index(m)))
    base = of["origin_period"]
    beats = "plus" in best and of[best]["hit5"] > base["hit5"] and of[best]["mrr5"] >= base["mrr5"]
    return {"selected_model": best, "b_enabled": b_helps, "personalization_beats_origin": beats}


def ranks(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def content_digest(df: DataFrame) -> DataFrame:
    """Rows and an order-independent digest of their contents."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("digest"))
