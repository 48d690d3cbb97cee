"""Binning rules that turn a reading into a named state.

Each rule is a list of (exclusive upper edge, label) plus the label above the
last edge. A null reading stays null unless the rule names a fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Edges and labels.
CPU = ([(20, "idle"), (50, "low"), (80, "medium")], "high")
RAM = ([(40, "low"), (75, "medium")], "high")
DISK = ([(0.1, "idle"), (10.0, "light")], "heavy")
SWAP = ([(1.0, "none"), (100.0, "low")], "high")
PROCESSES = ([(100, "light"), (300, "normal")], "heavy")
NETWORK = ([(1.0, "idle"), (100.0, "light")], "heavy")
TEMPERATURE = ([(40, "cool"), (60, "warm")], "hot")
FREQUENCY_POSITION = ([(0.33, "low"), (0.66, "mid")], "high")
DAY_HOURS = ([(5, "night"), (12, "morning"), (17, "afternoon"), (21, "evening")], "night")
SENSOR_PREFERENCE = ["coretemp", "k10temp", "acpitz", "cpu_thermal"]


def binned(value: Column, rule, missing: str | None = None) -> Column:
    edges, above = rule
    chain = F.when(value.isNull(), F.lit(missing))
    for upper, label in edges:
        chain = chain.when(value < F.lit(upper), F.lit(label))
    return chain.otherwise(F.lit(above))


def cpu_state(percent: Column) -> Column:
    return binned(percent, CPU)


def ram_state(percent: Column) -> Column:
    return binned(percent, RAM)


def disk_activity(read_mb: Column, write_mb: Column) -> Column:
    return binned(read_mb + write_mb, DISK)


def swap_state(used_mb: Column) -> Column:
    return binned(used_mb, SWAP)


def process_load_tier(count: Column) -> Column:
    return binned(count, PROCESSES)


def net_activity(sent_kb: Column, recv_kb: Column) -> Column:
    return binned(sent_kb + recv_kb, NETWORK)


def temp_state(celsius: Column) -> Column:
    return binned(celsius, TEMPERATURE, missing="unknown")


def freq_tier(mhz: Column, low: Column, high: Column) -> Column:
    """Position of a frequency inside the range seen so far."""
    spread = high - low
    position = F.try_divide(mhz - low, spread)
    return (
        F.when(mhz.isNull(), F.lit("unknown"))
        .when(spread.isNull() | (spread <= 0), F.lit("mid"))
        .otherwise(binned(position, FREQUENCY_POSITION))
    )


def time_period(ts: Column) -> Column:
    return binned(F.hour(ts), DAY_HOURS)


def weekday_type(ts: Column) -> Column:
    """Saturday and Sunday are weekend (weekday() counts from Monday = 0)."""
    day = F.weekday(ts)
    return F.when(day.isNull(), F.lit(None)).when(day >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))


def busiest_core(per_core: Column) -> Column:
    """First position of the highest load; ``core_0`` without readings."""
    first = F.array_position(per_core, F.array_max(per_core)) - 1
    return F.concat(F.lit("core_"), F.coalesce(first, F.lit(0)).cast("string"))


def _mean_reading(entries: Column) -> Column:
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["current"])
    return F.try_divide(total, F.size(entries))


def cpu_temp(sensors: Column) -> Column:
    """One temperature out of a map sensor -> entries.

    The first preferred sensor present wins: its first "package" entry, else
    the mean of its entries. With none of them, the first entry of the sensor
    whose name sorts lowest (a map has no order of its own).
    """
    def preferred(name: str) -> Column:
        entries = F.element_at(sensors, name)
        package = F.filter(entries, lambda e: F.lower(e["label"]).contains("package"))
        return F.when(F.size(package) > 0, F.get(package, F.lit(0))["current"]).otherwise(
            _mean_reading(entries))

    chain = F.when(sensors.isNull(), F.lit(None).cast("double"))
    for name in SENSOR_PREFERENCE:
        chain = chain.when(F.map_contains_key(sensors, name), preferred(name))
    lowest = F.element_at(sensors, F.array_min(F.map_keys(sensors)))
    chain = chain.when(F.size(sensors) > 0, F.get(lowest, F.lit(0))["current"])
    return F.round(chain, 2)
