"""python -m tripforge clean|audit|query|latency ..: batch commands."""

from __future__ import annotations

import argparse
import statistics
import sys
import time


def session(zone: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tripforge").config("spark.sql.session.timeZone", zone).getOrCreate()


def latency(run, iterations: int) -> tuple[float, float]:
    """Milliseconds of the median call and of the 95th percentile, by rank."""
    taken = []
    for _ in range(iterations):
        began = time.perf_counter()
        run()
        taken.append((time.perf_counter() - began) * 1000)
    return statistics.median(taken), sorted(taken)[round((iterations - 1) * 0.95)]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tripforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("clean", "audit"):
        p = commands.add_parser(name)
        p.add_argument("--input")
        p.add_argument("--output")
    for name in ("query", "latency"):
        p = commands.add_parser(name)
        p.add_argument("name")
        p.add_argument("tables")
        p.add_argument("--output")
        p.add_argument("--iterations", type=int, default=10)
    args = parser.parse_args(argv)
    if args.command == "latency":
        from tripforge.plans.registry import QUERIES

        spark = session("UTC")
        found = latency(lambda: QUERIES[args.name](spark, args.tables).write.format("noop").mode("overwrite").save(), args.iterations)
        print(f"{args.name} iterations={args.iterations} p50_ms={found[0]:.3f} p95_ms={found[1]:.3f}")
        return 0
    if args.command == "query":
        from tripforge.plans.registry import QUERIES

        df = QUERIES[args.name](session("UTC"), args.tables)
        df.write.mode("overwrite").parquet(args.output) if args.output else df.show(50, truncate=False)
        return 0
    from tripforge import config
    from tripforge.operators import clean
    from tripforge.sources.scratch import stored
    from tripforge.sources.trips_csv import audit, read_trips

    try:
        path = config.choose_input(".", args.input).resolve()
    except FileNotFoundError as x:
        print(x, file=sys.stderr)
        return 2
    spark = session("Asia/Taipei")
    try:
        rows = stored(clean.classified(read_trips(spark, str(path), clean.SOURCE_FIELDS)), "classified")
    except Exception as x:
        if "contract" not in str(x) and "no header" not in str(x):
            raise
        print("the file doesn't have the contract's header", file=sys.stderr)
        return 1
    if args.command == "audit":
        found = audit(rows, len(clean.SOURCE_FIELDS)).first()
        print(found.asDict())
        return 0 if not (found.wrong_width or found.rejected) else 1
    out = config.choose_output(".", "PROCESSED_DATA_DIR", args.output)
    trips = stored(clean.clean(rows), "trips")
    trips.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(f"{out}/trips_clean")
    clean.quarantine(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/trips_quarantine")
    counts = clean.quality(rows, trips)
    report = [r.asDict() for r in counts.collect()]
    config.write_json(f"{out}/quality_report.json", report)
    (out / "quality_report.md").write_text(clean.report(counts, clean.totals(rows, trips)), encoding="utf-8")
    files = [out / "quality_report.json", out / "quality_report.md"]
    config.write_json(f"{out}/manifest.json", config.manifest([path], {"zone": "Asia/Taipei"}, {"report": report}, files))
    return 0


if __name__ == "__main__":
    sys.exit(main())
