"""From counter snapshots to telemetry rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatt.functions import states as S
from tallywatt.plans.segments import with_history
from tallywatt.schema import TELEMETRY_COLUMNS

SESSION = ("host", "session_id")
# Output column, counter, unit.
COUNTERS = [
    ("disk_read_mb", "read_bytes", 1e6),
    ("disk_write_mb", "write_bytes", 1e6),
    ("net_sent_kb", "bytes_sent", 1e3),
    ("net_recv_kb", "bytes_recv", 1e3),
]


def scaled_delta(now: Column, before: Column, unit: float, on_reset: str = "keep") -> Column:
    """Counter step in the wanted unit; a missing reading gives 0.0.

    A reset gives a negative step, kept unless ``on_reset='zero'``.
    """
    step = F.round((now - before) / F.lit(unit), 4)
    if on_reset == "zero":
        step = F.greatest(step, F.lit(0.0))
    elif on_reset != "keep":
        raise ValueError(f"on_reset must be 'keep' or 'zero', not {on_reset!r}")
    return F.coalesce(step, F.lit(0.0))


def counter_delta(samples: DataFrame, keys: Sequence[str] = SESSION, order: str = "ts",
                  on_reset: str = "keep", parts: int | None = None) -> DataFrame:
    """Steps of the four counters between neighbouring samples of a session."""
    before = {counter: f"__prev_{counter}" for _, counter, _ in COUNTERS}
    rows = with_history(samples, keys, order, last=before, parts=parts)
    return rows.withColumns({
        name: scaled_delta(F.col(counter), F.col(before[counter]), unit, on_reset)
        for name, counter, unit in COUNTERS
    }).drop(*before.values())


def running_range(samples: DataFrame, col: str = "cpu_freq_mhz", keys: Sequence[str] = SESSION,
                  order: str = "ts", parts: int | None = None) -> DataFrame:
    """Lowest and highest reading so far in the session, nulls skipped."""
    return with_history(samples, keys, order, low={col: f"{col}_low"}, high={col: f"{col}_high"}, parts=parts)


def row_index(df: DataFrame, keys: Sequence[str], order: str, offset: int = 0, name: str = "sample_index",
              parts: int | None = None) -> DataFrame:
    """Row number per key from ``offset`` on (the rows already stored)."""
    rows = with_history(df, keys, order, index=name, parts=parts)
    return rows.withColumn(name, F.col(name) + F.lit(offset))


def telemetry_columns(deltas: dict[str, Column], low: Column, high: Column, index: Column,
                      temp: Column | None = None, core: Column | None = None) -> list[Column]:
    """The 24 columns of one sample, given its history.

    cpu and ram states use the unrounded reading; the others the stored one.
    The same expressions serve batch and stream.
    """
    freq = F.round("cpu_freq_mhz", 2)
    temp = S.cpu_temp(F.col("sensors")) if temp is None else temp
    core = S.busiest_core(F.col("per_core")) if core is None else core
    swap = F.round(F.col("swap_used") / 1e6, 2)
    read, write, sent, recv = (deltas[name] for name, _, _ in COUNTERS)
    columns = {
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        "cpu_freq_mhz": freq,
        "cpu_temp_celsius": temp,
        "cpu_percent": F.round("cpu_percent", 2),
        "ram_used_mb": F.round(F.col("mem_used") / 1e6, 2),
        "ram_percent": F.round("mem_percent", 2),
        "disk_read_mb": read,
        "disk_write_mb": write,
        "net_sent_kb": sent,
        "net_recv_kb": recv,
        "swap_used_mb": swap,
        "process_count": F.col("process_count"),
        "core_id": core,
        "cpu_state": S.cpu_state(F.col("cpu_percent")),
        "ram_state": S.ram_state(F.col("mem_percent")),
        "disk_activity": S.disk_activity(read, write),
        "swap_state": S.swap_state(swap),
        "process_load_tier": S.process_load_tier(F.col("process_count")),
        "net_activity": S.net_activity(sent, recv),
        "freq_tier": S.freq_tier(freq, low, high),
        "temp_state": S.temp_state(temp),
        "time_period": S.time_period(F.col("ts")),
        "weekday_type": S.weekday_type(F.col("ts")),
        "sample_index": index,
    }
    return [columns[c].alias(c) for c in TELEMETRY_COLUMNS]


def build_telemetry(samples: DataFrame, keys: Sequence[str] = SESSION, order: str = "ts",
                    on_reset: str = "keep", offset: int = 0, parts: int | None = None) -> DataFrame:
    """Telemetry rows (keys first), all history from one segmented pass.

    The row index runs per session key here; ``offset`` continues a table.
    Sensor maps and load arrays become scalars before the rows are shuffled.
    """
    before = {counter: f"__prev_{counter}" for _, counter, _ in COUNTERS}
    flat = samples.select(*dict.fromkeys([
        *keys, order, "ts", "cpu_percent", "cpu_freq_mhz", "mem_used", "mem_percent", "swap_used",
        *before, "process_count"]), S.cpu_temp(F.col("sensors")).alias("__temp"),
        S.busiest_core(F.col("per_core")).alias("__core"))
    rows = with_history(flat, keys, order, last=before, low={"cpu_freq_mhz": "__low"},
                        high={"cpu_freq_mhz": "__high"}, index="__index", parts=parts)
    deltas = {
        name: scaled_delta(F.col(counter), F.col(before[counter]), unit, on_reset)
        for name, counter, unit in COUNTERS
    }
    index = F.col("__index") + F.lit(offset)
    low, high = F.round("__low", 2), F.round("__high", 2)
    return rows.select(*keys, *telemetry_columns(deltas, low, high, index, F.col("__temp"), F.col("__core")))


def session_log(samples: DataFrame, keys: Sequence[str] = SESSION, stored_rows: int = 0) -> DataFrame:
    """Start, end, duration and row counts of each session."""
    log = samples.groupBy(*keys).agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count(F.lit(1)).alias("new_rows"),
    )
    micros = F.unix_micros("session_end") - F.unix_micros("session_start")
    return log.withColumns({
        "duration_s": micros / F.lit(1e6),
        "total_rows": F.col("new_rows") + F.lit(stored_rows),
    })
