"""Queries over telemetry built from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatt.catalog.registry import query
from tallywatt.catalog.rounding import rounded
from tallywatt.functions import states as S
from tallywatt.operators import clean, profile as P, telemetry as B
from tallywatt.operators.features import derive
from tallywatt.schema import DERIVED_COLUMNS, PROFILE_KEYS
from tallywatt.session import checkpoint_dir, stateful
from tallywatt.sources import adapters as A, sinks
from tallywatt.sources.tables import events, read_telemetry
from tallywatt.streaming import hot_sessions, telemetry_stream as streams


def run_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder for one run's tables."""
    return f"{checkpoint_dir(spark)}/tallywatt-{uuid.uuid4().hex}"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.telemetry_from_events(events(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.raw_samples_from_events(events(spark, sf_dir))


@query
def profile_float64(spark, sf_dir):
    return rounded(P.telemetry_profile(telemetry(spark, sf_dir), "double"))


@query
def profile_float32(spark, sf_dir):
    return rounded(P.telemetry_profile(telemetry(spark, sf_dir), "float"), 4)


@query
def profile_dedup(spark, sf_dir):
    return rounded(P.telemetry_profile(A.with_repeats(telemetry(spark, sf_dir))))


@query
def profile_constants_dropped(spark, sf_dir):
    return rounded(P.telemetry_profile(A.with_constants(telemetry(spark, sf_dir))))


@query
def profile_merge(spark, sf_dir):
    rows = derive(telemetry(spark, sf_dir)).withColumn("part", F.col("sample_index") % 4)
    return rounded(P.merge_profiles(P.partial_profile(rows, ["part", *PROFILE_KEYS]), PROFILE_KEYS))


@query
def constant_columns(spark, sf_dir):
    return clean.constant_report(A.with_nulls(A.with_constants(telemetry(spark, sf_dir))))


@query
def cast_dirty(spark, sf_dir):
    dirty = A.as_dirty_text(telemetry(spark, sf_dir))
    return clean.parse_timestamp(clean.cast_numeric(dirty, "double", ["process_count", "cpu_percent"]))


@query
def derive_features(spark, sf_dir):
    return rounded(derive(telemetry(spark, sf_dir)).select("sample_index", *DERIVED_COLUMNS))


@query
def derive_features_float32(spark, sf_dir):
    return rounded(derive(telemetry(spark, sf_dir), "float").select("sample_index", *DERIVED_COLUMNS), 4)


@query
def state_bins(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        "sample_index", "cpu_state", "ram_state", "disk_activity", "swap_state", "process_load_tier",
        "net_activity", "freq_tier", "temp_state", "time_period", "weekday_type")


@query
def busiest_core(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", S.busiest_core(F.col("per_core")).alias("core_id"))


@query
def cpu_temp(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", S.cpu_temp(F.col("sensors")).alias("cpu_temp_celsius"))


@query
def counter_delta(spark, sf_dir):
    rows = B.counter_delta(samples(spark, sf_dir))
    return rounded(rows.select("event_id", *[name for name, _, _ in B.COUNTERS]))


@query
def counter_delta_reset_zero(spark, sf_dir):
    rows = B.counter_delta(samples(spark, sf_dir), on_reset="zero")
    return rounded(rows.select("event_id", *[name for name, _, _ in B.COUNTERS]))


@query
def freq_tier(spark, sf_dir):
    rows = B.running_range(samples(spark, sf_dir))
    low, high = F.col("cpu_freq_mhz_low"), F.col("cpu_freq_mhz_high")
    return rows.select("event_id", "cpu_freq_mhz_low", "cpu_freq_mhz_high",
                       S.freq_tier(F.col("cpu_freq_mhz"), low, high).alias("freq_tier"))


@query
def build_telemetry(spark, sf_dir):
    return rounded(B.build_telemetry(samples(spark, sf_dir)))


@query
def row_index(spark, sf_dir):
    rows = B.row_index(samples(spark, sf_dir), ["host"], "ts", offset=100)
    return rows.select("event_id", "host", "sample_index")


@query
def session_log(spark, sf_dir):
    return rounded(B.session_log(samples(spark, sf_dir)))


@query
def category_codes(spark, sf_dir):
    return clean.category_codes(telemetry(spark, sf_dir))


@query
def encode_categories(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return clean.encode_categories(rows).select("sample_index", *clean.CATEGORY_COLUMNS)


@query
def decode_categories(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    codes = clean.category_codes(rows)
    back = clean.decode_categories(clean.encode_categories(rows, codes=codes), codes)
    return back.select("sample_index", *clean.CATEGORY_COLUMNS)


@query
def dedup_rows(spark, sf_dir):
    return clean.dedup(A.with_repeats(telemetry(spark, sf_dir))).select("sample_index", "cpu_percent", "core_id")


@query
def null_counts(spark, sf_dir):
    return clean.null_counts(A.with_nulls(telemetry(spark, sf_dir)))


@query
def duplicate_rows(spark, sf_dir):
    return clean.duplicate_rows(A.with_repeats(telemetry(spark, sf_dir)))


@query
def dedup_stored(spark, sf_dir):
    rows = clean.dedup_stored(A.with_repeats(telemetry(spark, sf_dir)))
    return rows.select("sample_index", "cpu_percent", "core_id", "timestamp")


@query
def drop_constant(spark, sf_dir):
    rows = clean.drop_constant(A.with_nulls(A.with_constants(telemetry(spark, sf_dir))))
    return clean.null_counts(rows).unionByName(
        rows.agg(F.lit("columns kept").alias("column"), F.lit(len(rows.columns)).cast("bigint").alias("nulls")))


@query
def distinct_counts(spark, sf_dir):
    return clean.distinct_counts(A.with_nulls(telemetry(spark, sf_dir)), [*clean.CATEGORY_COLUMNS, "process_count", "half_null", "all_null"])


@query
def profile_csv_copy(spark, sf_dir):
    """The profile of a CSV copy that was converted to Parquet."""
    folder = run_folder(spark)
    rows = telemetry(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    sinks.append_rows(rows, f"{folder}/t.csv", "csv")
    sinks.csv_to_parquet(spark, f"{folder}/t.csv", f"{folder}/t.parquet")
    return rounded(P.telemetry_profile(read_telemetry(spark, f"{folder}/t.parquet")))


FILES, ROWS_PER_FILE = 2, 100_000


def arriving(spark: SparkSession, sf_dir: str, folder: str, batches: int = 4) -> DataFrame:
    """The events as a stream of several micro-batches in time order: written in
    that order, as many files each, and that many files read at a time. A batch has
    FILES files or more, of some ROWS_PER_FILE rows, as a file is a task's share."""
    rows = events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts, n = rows.agg(F.percentile_approx("at", [k / batches for k in range(1, batches)]), F.count("at")).first()
    files = max(FILES, -(-n // (batches * ROWS_PER_FILE)))
    for low, high in zip([None, *cuts], [*cuts, None]):
        after, before = (F.lit(True) if low is None else F.col("at") >= low), (F.lit(True) if high is None else F.col("at") < high)
        rows.where(after & before).drop("at").repartition(files).write.mode("append").parquet(f"{folder}/events")
    schema = rows.drop("at").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")


@query
def stream_build_telemetry(spark, sf_dir):
    """The stateful stream form of ``build_telemetry``, over several micro-batches."""
    folder = run_folder(spark)
    rows = streams.stream_telemetry(A.raw_samples_from_events(arriving(spark, sf_dir, folder)))
    stateful(spark)
    streams.append_stream(rows, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").drop("late"))


@query
def stream_progress(spark, sf_dir):
    """What the progress events of a stream report, over all its micro-batches."""
    folder = run_folder(spark)
    rows = streams.with_progress(A.telemetry_from_events(arriving(spark, sf_dir, folder)))
    stream = streams.append_stream(rows, f"{folder}/out", f"{folder}/checkpoint", available_now=True)
    stream.awaitTermination()
    told = [p["observedMetrics"]["telemetry"] for p in stream.recentProgress if "telemetry" in p["observedMetrics"]]
    told = [(p["rows"], str(p["first"]), str(p["last"])) for p in (t.asDict() for t in told) if p["rows"]]
    table = spark.createDataFrame(told, "rows long, first string, last string")
    seconds = lambda c: F.unix_seconds(F.to_timestamp(c))  # progress events hold whole seconds
    return table.agg(F.sum("rows").alias("rows"), (F.count("*") > 1).alias("several"),
                     F.min(seconds("first")).alias("first_s"), F.max(seconds("last")).alias("last_s"))


@query
def stream_dedup_features(spark, sf_dir):
    """Repeated rows dropped on the stream, then the derived columns."""
    folder = run_folder(spark)
    source = events(spark, sf_dir)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    once = streams.stream_dedup(A.with_repeats(A.telemetry_from_events(stream)), ["sample_index"], "timestamp", "60 days")
    streams.append_stream(streams.stream_features(once), f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select("sample_index", *DERIVED_COLUMNS))


@query
def stream_hot_sessions(spark, sf_dir):
    """The micro-batch form of ``build_telemetry`` for dominant sessions, over
    several micro-batches."""
    folder = run_folder(spark)
    hot_sessions.build_stream(A.raw_samples_from_events(arriving(spark, sf_dir, folder)), f"{folder}/out", f"{folder}/state",
                              f"{folder}/checkpoint", available_now=True).awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").drop("late", "batch"))


@query
def overwrite_rows(spark, sf_dir):
    """A table that was started afresh holds the second rows only."""
    folder, rows = run_folder(spark), telemetry(spark, sf_dir).select("sample_index", "cpu_percent")
    sinks.append_rows(rows, f"{folder}/t")
    sinks.append_rows(rows.filter("sample_index % 3 = 0"), f"{folder}/t", overwrite=True)
    sinks.append_rows(rows.filter("sample_index % 3 = 1"), f"{folder}/t")
    return spark.read.parquet(f"{folder}/t")
