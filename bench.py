"""Headline timings: one JSON line.

Each query runs once as a warm-up and then REPEATS times; the median counts.
The measured window is read -> distinct rows -> transform -> aggregate, as in
the baseline; every row of the result is produced (noop sink).
``profile_*_500k`` repeat the profile on 500,000 distinct telemetry rows, the
baseline's table size, stored beforehand as Parquet and CSV.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from tallywatt.catalog import registry
from tallywatt.operators import profile as P
from tallywatt.session import local_session
from tallywatt.sources import adapters as A
from tallywatt.sources.tables import events, read_telemetry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
ROWS = 500_000
HEADLINE = [
    "profile_float64", "profile_float32", "profile_dedup", "profile_merge", "validate_telemetry",
    "build_telemetry", "counter_delta", "encode_categories", "fingerprint_groups",
    "config_summary", "summarize_runs", "main_effects", "describe_runs", "histogram", "leave_one_block_out",
    "type3_anova", "type3_unbalanced_blocks", "residuals", "levene", "brown_forsythe", "shapiro_wilk_log",
    "art_anova", "artc_engine_pairwise", "corr_spearman", "pareto_2d", "pareto_3d", "block_schedule_lines",
]


def timed(make) -> float:
    def once() -> float:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return round(statistics.median(once() for _ in range(REPEATS)), 4)


def stored_telemetry(spark) -> str:
    """Telemetry of ROWS distinct samples as Parquet and CSV."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    base = events(spark, SF_DIR)
    n = base.count()
    copies = -(-ROWS // n)
    many = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    many = many.withColumn("event_id", F.col("event_id") + F.col("i") * n).filter(F.col("event_id") < ROWS).drop("i")
    rows = A.telemetry_from_events(many).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    rows.repartition(int(CPUS)).write.parquet(f"{folder}/parquet")
    spark.read.parquet(f"{folder}/parquet").write.option("header", True).csv(f"{folder}/csv")
    return folder


def main() -> None:
    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: timed(lambda: registry.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    folder = stored_telemetry(spark)
    for fmt in ("parquet", "csv"):
        for dtype, label in (("double", "float64"), ("float", "float32")):
            queries[f"profile_{label}_{fmt}_500k"] = timed(
                lambda: P.telemetry_profile(read_telemetry(spark, f"{folder}/{fmt}", fmt), dtype))
    best = queries["profile_float32_parquet_500k"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "profile_rows_per_sec": round(ROWS / best), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
