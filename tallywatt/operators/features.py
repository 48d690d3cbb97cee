"""Derived telemetry columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywatt.operators.clean import cast_numeric, parse_timestamp

EPSILON = 1e-6  # fixed value: keeps an idle ratio finite


def _balance(a: Column, b: Column, dtype: str) -> Column:
    eps = F.lit(EPSILON).cast(dtype)
    return F.try_divide(a - b, a + b + eps).cast(dtype)


def derived_columns(dtype: str = "double") -> dict[str, Column]:
    """The six derived columns; every literal is typed, or FLOAT would widen."""
    read, write = F.col("disk_read_mb"), F.col("disk_write_mb")
    sent, recv = F.col("net_sent_kb"), F.col("net_recv_kb")
    return {
        "total_disk_throughput": (read + write).cast(dtype),
        "total_network_throughput": (sent + recv).cast(dtype),
        "cpu_headroom": (F.lit(100.0).cast(dtype) - F.col("cpu_percent")).cast(dtype),
        "disk_rw_balance": _balance(read, write, dtype),
        "net_sr_balance": _balance(sent, recv, dtype),
        "hour": F.hour("timestamp").cast(dtype),
    }


def derive(df: DataFrame, dtype: str = "double") -> DataFrame:
    """Cast the raw readings, parse the timestamp, add the derived columns."""
    return parse_timestamp(cast_numeric(df, dtype)).withColumns(derived_columns(dtype))
