"""Telemetry and run-log shaped views of the driver's tables.

All expressions are row-wise or one map-side combined aggregate, with integer
or single-step float arithmetic, so any SQL engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywatt.functions import states as S
from tallywatt.schema import FACTORS, TELEMETRY_COLUMNS


def load_percent() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """One telemetry row per event."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    num = lambda c: c.cast("double")
    out = events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        num(800 + (e * 37) % 3200).alias("cpu_freq_mhz"),
        F.when(e % 17 != 0, 30 + num((e * 13) % 500) / 10.0).alias("cpu_temp_celsius"),
        num(load_percent()).alias("cpu_percent"),
        num(((e * 7) % 1000) * 16).alias("ram_used_mb"),
        (num((e * 7) % 1000) / 10.0).alias("ram_percent"),
        F.round(v / 10.0, 4).alias("disk_read_mb"),
        (num(u % 7) * 0.5).alias("disk_write_mb"),
        F.round(v * 0.3, 4).alias("net_sent_kb"),
        (num(u % 11) * 9.0).alias("net_recv_kb"),
        (num(e % 5) * 30.0).alias("swap_used_mb"),
        (50 + (e * 3) % 400).alias("process_count"),
        F.concat(F.lit("core_"), (u % 8).cast("string")).alias("core_id"),
        e.alias("sample_index"),
    )
    c = F.col
    return out.withColumns({
        "cpu_state": S.cpu_state(c("cpu_percent")),
        "ram_state": S.ram_state(c("ram_percent")),
        "disk_activity": S.disk_activity(c("disk_read_mb"), c("disk_write_mb")),
        "swap_state": S.swap_state(c("swap_used_mb")),
        "process_load_tier": S.process_load_tier(c("process_count")),
        "net_activity": S.net_activity(c("net_sent_kb"), c("net_recv_kb")),
        "freq_tier": S.freq_tier(c("cpu_freq_mhz"), F.lit(800.0), F.lit(3999.0)),
        "temp_state": S.temp_state(c("cpu_temp_celsius")),
        "time_period": S.time_period(c("timestamp")),
        "weekday_type": S.weekday_type(c("timestamp")),
    }).select(*TELEMETRY_COLUMNS)


def with_repeats(telemetry: DataFrame) -> DataFrame:
    """Every row, and a second copy of every fiftieth."""
    return telemetry.unionByName(telemetry.filter(F.col("sample_index") % 50 == 0))


def with_constants(telemetry: DataFrame) -> DataFrame:
    return telemetry.withColumns({"swap_used_mb": F.lit(0.0), "swap_state": F.lit("none")})


def with_nulls(telemetry: DataFrame) -> DataFrame:
    """Adds a {null, x} column and an all-null column."""
    return telemetry.withColumns({
        "half_null": F.when(F.col("sample_index") % 2 == 0, F.lit("x")),
        "all_null": F.lit(None).cast("double"),
    })


def as_dirty_text(telemetry: DataFrame) -> DataFrame:
    """Text copies of four columns with unreadable cells and a NaN."""
    i = F.col("sample_index")
    return telemetry.select(
        "sample_index",
        F.when(i % 13 == 0, F.lit("abc")).when(i % 13 == 1, F.lit("NaN"))
        .otherwise(F.col("process_count").cast("string")).alias("process_count"),
        F.when(i % 11 == 0, F.lit("")).otherwise(F.col("cpu_percent").cast("int").cast("string")).alias("cpu_percent"),
        F.when(i % 7 == 0, F.lit("bad")).otherwise(
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
    )


def raw_samples_from_events(events: DataFrame) -> DataFrame:
    """Counter snapshots per host and session.

    The byte counters grow with event_id and fall back at every wrap, so the
    deltas include resets; some readings are missing.
    """
    e, u = F.col("event_id"), F.col("user_id")
    k = load_percent()
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("double").alias("current"))
    reading = 30 + ((e * 13) % 500).cast("double") / 8.0
    sensors = (
        F.when(e % 17 == 0, F.lit(None))
        .when(e % 4 == 0, F.create_map(
            F.lit("acpitz"), F.array(entry("", reading)),
            F.lit("coretemp"), F.array(entry("Core 0", reading), entry("Package id 0", reading + 5))))
        .when(e % 4 == 1, F.create_map(
            F.lit("k10temp"), F.array(entry("Tctl", reading), entry("Tccd", reading + 1))))
        .when(e % 4 == 2, F.create_map(
            F.lit("nvme"), F.array(entry("Composite", reading)),
            F.lit("iwlwifi"), F.array(entry("", reading + 2))))
        .otherwise(F.create_map(F.lit("cpu_thermal"), F.array(entry("", reading))))
    )
    return events.select(
        F.concat(F.lit("host_"), u.cast("string")).alias("host"),
        F.date_format("ts", "yyyy-MM").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (k.cast("double") + 0.125 * (e % 8)).alias("cpu_percent"),
        F.when(e % 19 != 0, (800 + (e * 37) % 3200).cast("double")).alias("cpu_freq_mhz"),
        sensors.alias("sensors"),
        (((e * 7) % 1000) * 16_000_000).alias("mem_used"),
        (((e * 7) % 1000).cast("double") / 10.0).alias("mem_percent"),
        ((e % 5) * 30_000_000).alias("swap_used"),
        F.when(e % 23 != 0, (e % 4096) * 1500 + k * 100).alias("read_bytes"),
        F.when(e % 23 != 0, (e % 3000) * 700).alias("write_bytes"),
        F.when(e % 29 != 0, (e % 5000) * 90 + u % 50).alias("bytes_sent"),
        F.when(e % 29 != 0, (e % 2500) * 40).alias("bytes_recv"),
        (50 + (e * 3) % 400).alias("process_count"),
        F.when(e % 31 != 0, F.array(k.cast("double"), (u % 100).cast("double"), (e % 100).cast("double"))
               ).alias("per_core"),
        e.alias("event_id"),
    )


def _parity(name: str) -> Column:
    return (F.col(name) % 2).cast("string")


def run_log_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Every line as one measured run: an unbalanced log with failed rows."""
    mode = F.when(F.col("l_partkey") % 2 == 0, "single").otherwise("parallel")
    out = lineitem.select(
        (F.col("l_orderkey") % 10 + 1).cast("int").alias("block"),
        F.col("l_linenumber").cast("int").alias("position_in_block"),
        F.col("l_returnflag").alias("engine"),
        F.col("l_linestatus").alias("data_format"),
        _parity("l_linenumber").alias("numeric_dtype"),
        _parity("l_suppkey").alias("categorical_dtype"),
        mode.alias("execution_mode"),
        F.col("l_extendedprice").alias("energy_j"),
        F.col("l_quantity").alias("runtime_s"),
        (100 + F.round(F.col("l_discount") * 100).cast("int") * 10).cast("double").alias("peak_rss_mb"),
        F.lit(100).cast("bigint").alias("rows_in"),
        F.col("l_linenumber").cast("bigint").alias("rows_out"),
        F.md5(F.col("l_quantity").cast("int").cast("string")).alias("result_hash"),
        F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(4).alias("workers"),
        F.when(F.col("l_tax") == 0.08, "error").otherwise("ok").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )
    return out.withColumn("config_id", F.concat_ws("__", *FACTORS))


def design_from_lineitem(lineitem: DataFrame, ok_only: bool = False) -> DataFrame:
    """A complete block design: one run per configuration and block, whose
    outcomes are the means of all lines of that cell. Sums run over integers
    (cents, units, percent), so the means do not depend on row order.
    """
    log = run_log_from_lineitem(lineitem)
    if ok_only:
        log = log.filter("status = 'ok'")
    cents = F.round(F.col("energy_j") * 100).cast("bigint")
    rows = F.count(F.lit(1))
    cells = log.groupBy("block", *FACTORS, "config_id", "workers").agg(
        (F.sum(cents).cast("double") / (rows.cast("double") * 100.0)).alias("energy_j"),
        (F.sum(F.col("runtime_s").cast("bigint")).cast("double") / rows).alias("runtime_s"),
        (F.sum(F.col("peak_rss_mb").cast("bigint")).cast("double") / rows).alias("peak_rss_mb"),
        rows.alias("rows_in"),
        F.max("rows_out").alias("rows_out"),
        F.md5(F.max("rows_out").cast("string")).alias("result_hash"),
    )
    return cells.withColumn("status", F.lit("ok"))
