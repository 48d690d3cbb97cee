"""Table contracts: column names, types, factor levels and fixed bin edges."""

from __future__ import annotations

from pyspark.sql import types as T

# The 24 telemetry columns in file order.
TELEMETRY_COLUMNS = [
    "timestamp",
    "cpu_freq_mhz",
    "cpu_temp_celsius",
    "cpu_percent",
    "ram_used_mb",
    "ram_percent",
    "disk_read_mb",
    "disk_write_mb",
    "net_sent_kb",
    "net_recv_kb",
    "swap_used_mb",
    "process_count",
    "core_id",
    "cpu_state",
    "ram_state",
    "disk_activity",
    "swap_state",
    "process_load_tier",
    "net_activity",
    "freq_tier",
    "temp_state",
    "time_period",
    "weekday_type",
    "sample_index",
]
# The numbers that are measured, and the texts that name their state.
CATEGORY_COLUMNS = [c for c in TELEMETRY_COLUMNS if c == "core_id" or c.endswith(
    ("_state", "_activity", "_tier", "_period", "_type"))]
NUMERIC_COLUMNS = [c for c in TELEMETRY_COLUMNS if c not in ("timestamp", "sample_index", *CATEGORY_COLUMNS)]
DERIVED_COLUMNS = [
    "total_disk_throughput",
    "total_network_throughput",
    "cpu_headroom",
    "disk_rw_balance",
    "net_sr_balance",
    "hour",
]
# The profile's keys and statistics.
PROFILE_KEYS = ["weekday_type", "time_period", "cpu_state"]
PROFILE_STATS = ["count", "mean", "std", "min", "max"]
# Columns that later steps need, so they survive even when constant.
PROTECTED_COLUMNS = frozenset(
    ["sample_index", "timestamp", "cpu_percent", "disk_read_mb", "disk_write_mb",
     "net_sent_kb", "net_recv_kb", *PROFILE_KEYS]
)


def telemetry_schema(timestamp_type: T.DataType | None = None, dirty: bool = False) -> T.StructType:
    """The telemetry file schema; ``dirty`` reads every column as text."""
    def kind(name: str) -> T.DataType:
        if dirty or name in CATEGORY_COLUMNS:
            return T.StringType()
        if name == "timestamp":
            return timestamp_type or T.StringType()
        if name in ("process_count", "sample_index"):
            return T.LongType()
        return T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in TELEMETRY_COLUMNS])


RAW_SAMPLE_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("cpu_percent", T.DoubleType()),
    T.StructField("cpu_freq_mhz", T.DoubleType()),
    T.StructField("sensors", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("current", T.DoubleType()),
    ])))),
    T.StructField("mem_used", T.LongType()),
    T.StructField("mem_percent", T.DoubleType()),
    T.StructField("swap_used", T.LongType()),
    T.StructField("read_bytes", T.LongType()),
    T.StructField("write_bytes", T.LongType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("bytes_recv", T.LongType()),
    T.StructField("process_count", T.LongType()),
    T.StructField("per_core", T.ArrayType(T.DoubleType())),
])

# Factors and outcomes of an experiment.
FACTORS = ["engine", "data_format", "numeric_dtype", "categorical_dtype", "execution_mode"]
OUTCOMES = ["energy_j", "runtime_s", "peak_rss_mb"]

# Run-log columns in file order.
RUN_COLUMNS = [
    ("block", "int"),
    ("position_in_block", "int"),
    ("engine", "string"),
    ("data_format", "string"),
    ("numeric_dtype", "string"),
    ("categorical_dtype", "string"),
    ("threading_mode", "string"),
    ("config_id", "string"),
    ("runtime_s", "double"),
    ("energy_j", "double"),
    ("peak_rss_mb", "double"),
    ("rows_in", "bigint"),
    ("rows_out", "bigint"),
    ("result_hash", "string"),
    ("workers", "int"),
    ("status", "string"),
    ("error", "string"),
    ("timestamp", "string"),
]
RUN_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RUN_COLUMNS)
# Run-log columns that an analysis needs.
REQUIRED_RUN_COLUMNS = [
    "block", "position_in_block", *FACTORS, "config_id", *OUTCOMES,
    "rows_in", "rows_out", "result_hash", "workers", "status",
]

# Declared level order of the published design.
PUBLISHED_LEVELS = {
    "engine": ["pandas_numpy", "pandas_pyarrow", "polars_eager", "polars_lazy",
               "duckdb", "dask_default", "dask_pyarrow", "python_loops"],
    "data_format": ["csv", "parquet"],
    "numeric_dtype": ["float32", "float64"],
    "categorical_dtype": ["object", "category"],
    "execution_mode": ["single", "parallel"],
}
