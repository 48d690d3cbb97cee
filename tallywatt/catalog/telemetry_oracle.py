"""SQL twins of the telemetry queries."""

from __future__ import annotations

from tallywatt.catalog.rounding import rounded_sql
from tallywatt.schema import CATEGORY_COLUMNS, DERIVED_COLUMNS, NUMERIC_COLUMNS, PROFILE_KEYS, TELEMETRY_COLUMNS

SQL: dict[str, str] = {}

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"


def _bins(value: str, edges: list[tuple[float, str]], above: str, missing: str = "NULL") -> str:
    whens = " ".join(f"WHEN {value} < {edge}::DOUBLE THEN '{label}'" for edge, label in edges)
    return f"CASE WHEN {value} IS NULL THEN {missing} {whens} ELSE '{above}' END"


def cpu_state(x):
    return _bins(x, [(20, "idle"), (50, "low"), (80, "medium")], "high")


def ram_state(x):
    return _bins(x, [(40, "low"), (75, "medium")], "high")


def disk_activity(r, w):
    return _bins(f"({r} + {w})", [(0.1, "idle"), (10, "light")], "heavy")


def swap_state(x):
    return _bins(x, [(1, "none"), (100, "low")], "high")


def process_load_tier(x):
    return _bins(x, [(100, "light"), (300, "normal")], "heavy")


def net_activity(s, r):
    return _bins(f"({s} + {r})", [(1, "idle"), (100, "light")], "heavy")


def temp_state(x):
    return _bins(x, [(40, "cool"), (60, "warm")], "hot", "'unknown'")


def freq_tier(f, lo, hi):
    pos = f"(({f} - {lo}) / nullif({hi} - {lo}, 0))"
    return (f"CASE WHEN {f} IS NULL THEN 'unknown' WHEN {hi} - {lo} <= 0 OR {hi} IS NULL THEN 'mid' "
            f"WHEN {pos} < 0.33::DOUBLE THEN 'low' WHEN {pos} < 0.66::DOUBLE THEN 'mid' ELSE 'high' END")


def time_period(ts):
    return (f"CASE WHEN hour({ts}) BETWEEN 5 AND 11 THEN 'morning' WHEN hour({ts}) BETWEEN 12 AND 16 THEN 'afternoon' "
            f"WHEN hour({ts}) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END")


def weekday_type(ts):
    return f"CASE WHEN dayofweek({ts}) IN (0, 6) THEN 'weekend' ELSE 'weekday' END"


TELEMETRY = f"""
base AS (
  SELECT ts AS "timestamp",
    CAST(800 + (event_id * 37) % 3200 AS DOUBLE) AS cpu_freq_mhz,
    CASE WHEN event_id % 17 <> 0 THEN 30 + CAST((event_id * 13) % 500 AS DOUBLE) / 1e1 END AS cpu_temp_celsius,
    CAST({K} AS DOUBLE) AS cpu_percent,
    CAST(((event_id * 7) % 1000) * 16 AS DOUBLE) AS ram_used_mb,
    CAST((event_id * 7) % 1000 AS DOUBLE) / 1e1 AS ram_percent,
    round(value / 1e1, 4) AS disk_read_mb,
    CAST(user_id % 7 AS DOUBLE) * 5e-1 AS disk_write_mb,
    round(value * 3e-1, 4) AS net_sent_kb,
    CAST(user_id % 11 AS DOUBLE) * 9e0 AS net_recv_kb,
    CAST(event_id % 5 AS DOUBLE) * 3e1 AS swap_used_mb,
    50 + (event_id * 3) % 400 AS process_count,
    'core_' || CAST(user_id % 8 AS VARCHAR) AS core_id,
    event_id AS sample_index
  FROM events),
telemetry AS (
  SELECT *, {cpu_state('cpu_percent')} AS cpu_state, {ram_state('ram_percent')} AS ram_state,
    {disk_activity('disk_read_mb', 'disk_write_mb')} AS disk_activity, {swap_state('swap_used_mb')} AS swap_state,
    {process_load_tier('process_count')} AS process_load_tier, {net_activity('net_sent_kb', 'net_recv_kb')} AS net_activity,
    {freq_tier('cpu_freq_mhz', '8e2', '3999e0')} AS freq_tier, {temp_state('cpu_temp_celsius')} AS temp_state,
    {time_period('"timestamp"')} AS time_period, {weekday_type('"timestamp"')} AS weekday_type
  FROM base)
"""


def derived(t: str, source: str, name: str = "derived") -> str:
    """Casts and derived columns in type ``t``."""
    numeric = ", ".join(f"CAST({c} AS {t}) AS {c}" for c in NUMERIC_COLUMNS)
    rest = ", ".join(f'"{c}"' for c in TELEMETRY_COLUMNS if c not in NUMERIC_COLUMNS)
    return f"""
cast_{name} AS (SELECT {rest}, {numeric} FROM {source}),
{name} AS (SELECT *,
    CAST(disk_read_mb + disk_write_mb AS {t}) AS total_disk_throughput,
    CAST(net_sent_kb + net_recv_kb AS {t}) AS total_network_throughput,
    CAST(CAST(100 AS {t}) - cpu_percent AS {t}) AS cpu_headroom,
    CAST((disk_read_mb - disk_write_mb) / (disk_read_mb + disk_write_mb + CAST(1e-6 AS {t})) AS {t}) AS disk_rw_balance,
    CAST((net_sent_kb - net_recv_kb) / (net_sent_kb + net_recv_kb + CAST(1e-6 AS {t})) AS {t}) AS net_sr_balance,
    CAST(hour("timestamp") AS {t}) AS "hour"
  FROM cast_{name})"""


def profile_select(source: str, cols: list[str], digits: int) -> str:
    parts = []
    for c in cols:
        parts.append(f"count({c}) AS {c}_count")
        parts += [f"{rounded_sql(e, digits)} AS {c}_{name}" for name, e in (
            ("mean", f"avg(CAST({c} AS DOUBLE))"), ("std", f"stddev_samp(CAST({c} AS DOUBLE))"),
            ("min", f"CAST(min({c}) AS DOUBLE)"), ("max", f"CAST(max({c}) AS DOUBLE)"))]
    return f"SELECT {', '.join(PROFILE_KEYS)}, {', '.join(parts)} FROM {source} GROUP BY ALL"


ALL = [*NUMERIC_COLUMNS, *DERIVED_COLUMNS]
SQL["profile_float64"] = f"WITH {TELEMETRY}, {derived('DOUBLE', 'telemetry')} {profile_select('derived', ALL, 6)}"
SQL["profile_float32"] = f"WITH {TELEMETRY}, {derived('FLOAT', 'telemetry')} {profile_select('derived', ALL, 4)}"
SQL["profile_dedup"] = f"""WITH {TELEMETRY},
repeated AS (SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE sample_index % 50 = 0),
rows_once AS (SELECT DISTINCT * FROM repeated), {derived('DOUBLE', 'rows_once')} {profile_select('derived', ALL, 6)}"""
SQL["profile_constants_dropped"] = (
    f"WITH {TELEMETRY}, {derived('DOUBLE', 'telemetry')} "
    + profile_select("derived", [c for c in ALL if c != "swap_used_mb"], 6))
SQL["profile_merge"] = f"WITH {TELEMETRY}, {derived('DOUBLE', 'telemetry')} " + " UNION ALL ".join(
    f"SELECT {', '.join(PROFILE_KEYS)}, '{c}' AS \"column\", count({c}) AS \"count\", {rounded_sql(f'avg({c})')} AS \"mean\", "
    f"{rounded_sql(f'stddev_samp({c})')} AS std, {rounded_sql(f'min({c})')} AS \"min\", {rounded_sql(f'max({c})')} AS \"max\" "
    f"FROM derived GROUP BY ALL" for c in ALL)

_checked = [c for c in TELEMETRY_COLUMNS if c not in (
    "sample_index", "timestamp", "cpu_percent", "disk_read_mb", "disk_write_mb", "net_sent_kb", "net_recv_kb",
    *PROFILE_KEYS)] + ["half_null", "all_null"]
SQL["constant_columns"] = f"""WITH {TELEMETRY}, changed AS (
  SELECT * REPLACE (0.0::DOUBLE AS swap_used_mb, 'none' AS swap_state),
    CASE WHEN sample_index % 2 = 0 THEN 'x' END AS half_null, CAST(NULL AS DOUBLE) AS all_null FROM telemetry) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INTEGER) <= 1 AS is_constant FROM changed"
    for c in _checked)
SQL["cast_dirty"] = f"""WITH {TELEMETRY}, dirty AS (SELECT sample_index,
    CASE WHEN sample_index % 13 = 0 THEN 'abc' WHEN sample_index % 13 = 1 THEN 'NaN' ELSE CAST(process_count AS VARCHAR) END AS process_count,
    CASE WHEN sample_index % 11 = 0 THEN '' ELSE CAST(CAST(cpu_percent AS INTEGER) AS VARCHAR) END AS cpu_percent,
    CASE WHEN sample_index % 7 = 0 THEN 'bad' ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS "timestamp" FROM telemetry)
SELECT sample_index, nullif(TRY_CAST(process_count AS DOUBLE), 'NaN'::DOUBLE) AS process_count,
  TRY_CAST(cpu_percent AS DOUBLE) AS cpu_percent, TRY_CAST("timestamp" AS TIMESTAMP) AS "timestamp" FROM dirty"""
SQL["derive_features"] = f"WITH {TELEMETRY}, {derived('DOUBLE', 'telemetry')} SELECT sample_index, " + ", ".join(
    f'{rounded_sql(c)} AS "{c}"' for c in DERIVED_COLUMNS) + " FROM derived"
SQL["derive_features_float32"] = f"WITH {TELEMETRY}, {derived('FLOAT', 'telemetry')} SELECT sample_index, " + ", ".join(
    f'{rounded_sql(f"CAST({c} AS DOUBLE)", 4)} AS "{c}"' for c in DERIVED_COLUMNS) + " FROM derived"
SQL["state_bins"] = f"""WITH {TELEMETRY} SELECT sample_index, cpu_state, ram_state, disk_activity, swap_state,
  process_load_tier, net_activity, freq_tier, temp_state, time_period, weekday_type FROM telemetry"""

SAMPLES = f"""
samples AS (
  SELECT 'host_' || CAST(user_id AS VARCHAR) AS host, strftime(ts, '%Y-%m') AS session_id, ts,
    {K} + 0.125::DOUBLE * (event_id % 8) AS cpu_percent,
    CASE WHEN event_id % 19 <> 0 THEN CAST(800 + (event_id * 37) % 3200 AS DOUBLE) END AS cpu_freq_mhz,
    30 + CAST((event_id * 13) % 500 AS DOUBLE) / 8e0 AS reading,
    ((event_id * 7) % 1000) * 16000000 AS mem_used,
    CAST((event_id * 7) % 1000 AS DOUBLE) / 1e1 AS mem_percent,
    (event_id % 5) * 30000000 AS swap_used,
    CASE WHEN event_id % 23 <> 0 THEN (event_id % 4096) * 1500 + {K} * 100 END AS read_bytes,
    CASE WHEN event_id % 23 <> 0 THEN (event_id % 3000) * 700 END AS write_bytes,
    CASE WHEN event_id % 29 <> 0 THEN (event_id % 5000) * 90 + user_id % 50 END AS bytes_sent,
    CASE WHEN event_id % 29 <> 0 THEN (event_id % 2500) * 40 END AS bytes_recv,
    50 + (event_id * 3) % 400 AS process_count,
    CASE WHEN event_id % 31 <> 0 THEN [CAST({K} AS DOUBLE), CAST(user_id % 100 AS DOUBLE), CAST(event_id % 100 AS DOUBLE)] END AS per_core,
    event_id
  FROM events)
"""
CORE = "'core_' || CAST(coalesce(list_position(per_core, list_max(per_core)) - 1, 0) AS VARCHAR)"
TEMP = """round(CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 THEN reading + 5
  WHEN event_id % 4 = 1 THEN (reading + (reading + 1)) / 2 WHEN event_id % 4 = 2 THEN reading + 2 ELSE reading END, 2)"""
SQL["busiest_core"] = f"WITH {SAMPLES} SELECT event_id, {CORE} AS core_id FROM samples"
SQL["cpu_temp"] = f"WITH {SAMPLES} SELECT event_id, {TEMP} AS cpu_temp_celsius FROM samples"


def _delta(counter: str, unit: str, zero: bool) -> str:
    step = f"round(({counter} - lag({counter}) OVER w) / {unit}, 4)"
    if zero:
        step = f"CASE WHEN {step} < 0 THEN 0.0 ELSE {step} END"
    return f"round(coalesce({step}, 0.0::DOUBLE), 6)"


def _deltas(zero: bool = False) -> str:
    return ", ".join(f"{_delta(c, u, zero)} AS {n}" for n, c, u in [
        ("disk_read_mb", "read_bytes", "1e6"), ("disk_write_mb", "write_bytes", "1e6"),
        ("net_sent_kb", "bytes_sent", "1e3"), ("net_recv_kb", "bytes_recv", "1e3")])


WINDOW = "WINDOW w AS (PARTITION BY host, session_id ORDER BY ts), r AS (PARTITION BY host, session_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
SQL["counter_delta"] = f"WITH {SAMPLES} SELECT event_id, {_deltas()} FROM samples {WINDOW}"
SQL["counter_delta_reset_zero"] = f"WITH {SAMPLES} SELECT event_id, {_deltas(True)} FROM samples {WINDOW}"
RANGED = f"ranged AS (SELECT *, min(cpu_freq_mhz) OVER r AS lo, max(cpu_freq_mhz) OVER r AS hi, {_deltas()}, row_number() OVER w - 1 AS idx FROM samples {WINDOW})"
SQL["freq_tier"] = f"""WITH {SAMPLES}, {RANGED} SELECT event_id, lo AS cpu_freq_mhz_low, hi AS cpu_freq_mhz_high,
  {freq_tier('cpu_freq_mhz', 'lo', 'hi')} AS freq_tier FROM ranged"""
SQL["build_telemetry"] = f"""WITH {SAMPLES}, {RANGED},
shaped AS (SELECT *, {TEMP} AS temp, round(swap_used / 1e6, 2) AS swap_mb FROM ranged)
SELECT host, session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS "timestamp", round(cpu_freq_mhz, 2) AS cpu_freq_mhz,
  temp AS cpu_temp_celsius, round(cpu_percent, 2) AS cpu_percent, round(mem_used / 1e6, 2) AS ram_used_mb,
  round(mem_percent, 2) AS ram_percent, disk_read_mb, disk_write_mb, net_sent_kb, net_recv_kb, swap_mb AS swap_used_mb,
  process_count, {CORE} AS core_id, {cpu_state('cpu_percent')} AS cpu_state, {ram_state('mem_percent')} AS ram_state,
  {disk_activity('disk_read_mb', 'disk_write_mb')} AS disk_activity, {swap_state('swap_mb')} AS swap_state,
  {process_load_tier('process_count')} AS process_load_tier, {net_activity('net_sent_kb', 'net_recv_kb')} AS net_activity,
  {freq_tier('cpu_freq_mhz', 'lo', 'hi')} AS freq_tier, {temp_state('temp')} AS temp_state,
  {time_period('ts')} AS time_period, {weekday_type('ts')} AS weekday_type, idx AS sample_index FROM shaped"""
SQL["row_index"] = f"WITH {SAMPLES} SELECT event_id, host, row_number() OVER (PARTITION BY host ORDER BY ts) + 99 AS sample_index FROM samples"
SQL["session_log"] = f"""WITH {SAMPLES} SELECT host, session_id, min(ts) AS session_start, max(ts) AS session_end,
  count(*) AS new_rows, count(*) AS total_rows, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_s
  FROM samples GROUP BY ALL"""
_codes = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", value, CAST(row_number() OVER (ORDER BY coalesce(value, 'missing'), value IS NULL) - 1 AS INTEGER) AS code FROM "
    f"(SELECT DISTINCT {c} AS value FROM telemetry)" for c in CATEGORY_COLUMNS)
SQL["category_codes"] = f"WITH {TELEMETRY} {_codes}"
SQL["encode_categories"] = f"WITH {TELEMETRY} SELECT sample_index, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'missing'), {c} IS NULL) - 1 AS INTEGER) AS {c}" for c in CATEGORY_COLUMNS) + " FROM telemetry"
SQL["decode_categories"] = f"WITH {TELEMETRY} SELECT sample_index, {', '.join(CATEGORY_COLUMNS)} FROM telemetry"
SQL["dedup_rows"] = f"WITH {TELEMETRY} SELECT sample_index, cpu_percent, core_id FROM telemetry"
SQL["null_counts"] = f"""WITH {TELEMETRY}, changed AS (SELECT *, CASE WHEN sample_index % 2 = 0 THEN 'x' END AS half_null,
  CAST(NULL AS DOUBLE) AS all_null FROM telemetry) SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS nulls FROM changed"
    for c in [*TELEMETRY_COLUMNS, "half_null", "all_null"]) + ") WHERE nulls > 0"
SQL["duplicate_rows"] = f"""WITH {TELEMETRY},
repeated AS (SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE sample_index % 50 = 0)
SELECT (SELECT count(*) FROM repeated) - (SELECT count(*) FROM (SELECT DISTINCT * FROM repeated)) AS duplicate_rows"""
SQL["dedup_stored"] = f"WITH {TELEMETRY} SELECT sample_index, cpu_percent, core_id, \"timestamp\" FROM telemetry"
SQL["drop_constant"] = f"""WITH {TELEMETRY} SELECT 'columns kept' AS "column", CAST(23 AS BIGINT) AS nulls
UNION ALL SELECT 'half_null', count(*) FILTER (sample_index % 2 <> 0) FROM telemetry
UNION ALL SELECT 'cpu_temp_celsius', count(*) FILTER (cpu_temp_celsius IS NULL) FROM telemetry"""
SQL["distinct_counts"] = f"""WITH {TELEMETRY}, changed AS (SELECT *, CASE WHEN sample_index % 2 = 0 THEN 'x' END AS half_null,
  CAST(NULL AS DOUBLE) AS all_null FROM telemetry) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS BIGINT) AS \"distinct\" FROM changed"
    for c in [*CATEGORY_COLUMNS, "process_count", "half_null", "all_null"])
SQL["profile_csv_copy"] = SQL["profile_float64"]
SQL["stream_build_telemetry"] = SQL["build_telemetry"]
SQL["stream_dedup_features"] = SQL["derive_features"]
SQL["stream_hot_sessions"] = SQL["build_telemetry"]
SQL["stream_progress"] = f"""WITH {TELEMETRY} SELECT count(*) AS "rows", true AS several, epoch_us(min("timestamp")) // 1000000 AS first_s,
  epoch_us(max("timestamp")) // 1000000 AS last_s FROM telemetry"""
SQL["overwrite_rows"] = f"WITH {TELEMETRY} SELECT sample_index, cpu_percent FROM telemetry WHERE sample_index % 3 < 2"
