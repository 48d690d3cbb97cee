"""SQL twins of the run-log queries."""

from __future__ import annotations

from itertools import combinations

from tallywatt.catalog.rounding import rounded_sql
from tallywatt.catalog.solve_oracle import Columns
from tallywatt.catalog.tail_oracle import f_tail, normal_quantile, normal_tail
from tallywatt.catalog.telemetry_oracle import ALL, TELEMETRY, derived
from tallywatt.schema import FACTORS, NUMERIC_COLUMNS, OUTCOMES, PROFILE_KEYS, TELEMETRY_COLUMNS

SQL: dict[str, str] = {}

LEVELS = {
    "engine": ["A", "N", "R"],
    "data_format": ["F", "O"],
    "numeric_dtype": ["0", "1"],
    "categorical_dtype": ["0", "1"],
    "execution_mode": ["single", "parallel"],
}
F5 = ", ".join(FACTORS)

LOG = """
runs0 AS (
  SELECT CAST(l_orderkey % 10 + 1 AS INTEGER) AS block, CAST(l_linenumber AS INTEGER) AS position_in_block,
    l_returnflag AS engine, l_linestatus AS data_format, CAST(l_linenumber % 2 AS VARCHAR) AS numeric_dtype,
    CAST(l_suppkey % 2 AS VARCHAR) AS categorical_dtype,
    CASE WHEN l_partkey % 2 = 0 THEN 'single' ELSE 'parallel' END AS execution_mode,
    l_extendedprice AS energy_j, l_quantity AS runtime_s,
    CAST(100 + 10 * CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) AS peak_rss_mb,
    100 AS rows_in, CAST(l_linenumber AS BIGINT) AS rows_out,
    md5(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS result_hash,
    CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 4 END AS workers,
    CASE WHEN l_tax = 0.08::DOUBLE THEN 'error' ELSE 'ok' END AS status, l_shipdate AS "timestamp"
  FROM lineitem),
log AS (SELECT *, concat_ws('__', engine, data_format, numeric_dtype, categorical_dtype, execution_mode) AS config_id FROM runs0),
ok AS (SELECT * FROM log WHERE status = 'ok')
"""
DESIGN = f"""{LOG},
design AS (
  SELECT block, {F5}, config_id, workers,
    CAST(sum(CAST(round(energy_j * 100) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100e0) AS energy_j,
    CAST(sum(CAST(runtime_s AS BIGINT)) AS DOUBLE) / count(*) AS runtime_s,
    CAST(sum(CAST(peak_rss_mb AS BIGINT)) AS DOUBLE) / count(*) AS peak_rss_mb,
    count(*) AS rows_in, max(rows_out) AS rows_out
  FROM log GROUP BY ALL)
"""


def hash_key(seed_block: str, unit: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({seed_block} AS VARCHAR) || '-' || CAST({unit} AS VARCHAR)), 1, 13) AS BIGINT)"


# --- samples -----------------------------------------------------------------
SQL["sample_first"] = f"WITH {TELEMETRY} SELECT sample_index, cpu_percent, core_id FROM telemetry ORDER BY sample_index LIMIT 500"
SQL["sample_random"] = f"""WITH {TELEMETRY} SELECT sample_index, cpu_percent, core_id FROM telemetry
  ORDER BY {hash_key('7', 'sample_index')}, sample_index LIMIT 500"""

SQL["sample_first_large"] = """WITH t AS (SELECT CASE WHEN l_linenumber <> 1 THEN l_quantity END AS k, l_orderkey, l_linenumber, l_partkey FROM lineitem)
SELECT * FROM t ORDER BY k NULLS FIRST, l_orderkey, l_linenumber, l_partkey LIMIT 25000"""
SQL["sample_random_large"] = f"""WITH t AS (SELECT l_orderkey * 8 + l_linenumber AS line, l_extendedprice FROM lineitem)
SELECT * FROM t ORDER BY {hash_key('3', 'line')}, line, l_extendedprice LIMIT 12000"""

SQL["stored_subset"] = """SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS sample_index, l_partkey, l_quantity FROM lineitem
  ORDER BY ALL LIMIT 3000"""
SQL["run_log_read_back"] = f"""WITH {LOG} SELECT engine, execution_mode, count(*) AS runs,
  CAST(sum(CAST(round(energy_j * 100) AS BIGINT)) AS BIGINT) AS cents FROM ok GROUP BY ALL"""
SQL["run_metadata"] = f"""WITH {DESIGN} SELECT count(DISTINCT config_id) AS configuration_count, count(DISTINCT block) AS runs_per_configuration,
  count(*) AS measured_run_count, 42::BIGINT AS seed FROM design"""
SQL["write_result"] = f"WITH {LOG} SELECT config_id, count(*) AS runs FROM ok GROUP BY ALL"
SQL["level_order"] = f"WITH {LOG} SELECT factor, level, CAST(row_number() OVER (PARTITION BY factor ORDER BY level) - 1 AS INTEGER) AS position FROM (" + (
    " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS factor, {f} AS level FROM log" for f in FACTORS)) + ")"
SQL["optional_tables"] = """SELECT 'orders' AS name, count(*) AS "rows" FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier
  UNION ALL SELECT 'absent', NULL"""

# --- data quality ------------------------------------------------------------
CHANGED = """changed AS (SELECT * REPLACE (0.0::DOUBLE AS swap_used_mb, 'none' AS swap_state),
    CASE WHEN sample_index % 2 = 0 THEN 'x' END AS half_null, CAST(NULL AS DOUBLE) AS all_null FROM {source})"""
_free = [c for c in TELEMETRY_COLUMNS if c not in (
    "sample_index", "timestamp", "cpu_percent", "disk_read_mb", "disk_write_mb", "net_sent_kb", "net_recv_kb",
    *PROFILE_KEYS)] + ["half_null", "all_null"]
_names = [*TELEMETRY_COLUMNS, "half_null", "all_null"]
SQL["validate_telemetry"] = f"""WITH {TELEMETRY},
repeated AS (SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE sample_index % 50 = 0),
{CHANGED.format(source='repeated')}, once AS (SELECT DISTINCT * FROM changed),
facts AS (
  SELECT 'rows' AS "check", CAST(NULL AS VARCHAR) AS "column", (SELECT count(*) FROM changed) AS "value"
  UNION ALL SELECT 'columns', NULL, 26
  UNION ALL SELECT 'duplicate_rows', NULL, (SELECT count(*) FROM changed) - (SELECT count(*) FROM once)
  UNION ALL SELECT 'extra', 'half_null', 1 UNION ALL SELECT 'extra', 'all_null', 1
  UNION ALL SELECT 'copy_second_rows', NULL, (SELECT count(*) FROM telemetry)
  UNION ALL SELECT 'copy_second_columns', NULL, 26 UNION ALL SELECT 'copy_same_column_order', NULL, 1
  UNION ALL SELECT 'copy_same_row_count', NULL, CAST((SELECT count(*) FROM changed) = (SELECT count(*) FROM telemetry) AS INTEGER)
  UNION ALL SELECT 'copy_only_in_first', NULL, (SELECT count(*) FROM changed) - (SELECT count(*) FROM once)
  UNION ALL SELECT 'copy_only_in_second', NULL, 0
  UNION ALL SELECT 'constant', "column", 1 FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INTEGER) <= 1 AS flag FROM changed"
    for c in _free) + """) WHERE flag
  UNION ALL SELECT 'nulls', "column", nulls FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS nulls FROM changed" for c in _names) + """) WHERE nulls > 0)
SELECT "check", "column", CAST("value" AS BIGINT) AS "value" FROM facts"""
SQL["copy_compare"] = f"""WITH {TELEMETRY},
repeated AS (SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE sample_index % 50 = 0)
SELECT (SELECT count(*) FROM telemetry) AS first_rows, (SELECT count(*) FROM repeated) AS second_rows,
  (SELECT count(*) FROM (SELECT * FROM telemetry EXCEPT ALL SELECT * FROM repeated)) AS only_in_first,
  (SELECT count(*) FROM (SELECT * FROM repeated EXCEPT ALL SELECT * FROM telemetry)) AS only_in_second,
  24 AS first_columns, 24 AS second_columns, true AS same_column_order,
  (SELECT count(*) FROM telemetry) = (SELECT count(*) FROM repeated) AS same_row_count"""


def _json(cols: dict[str, bool]) -> str:
    parts = []
    for c in sorted(cols):
        text = f"CAST(round_even({c} * 1e7, 0) / 1e7 AS VARCHAR)" if cols[c] else f"'\"' || CAST(\"{c}\" AS VARCHAR) || '\"'"
        parts.append(f"'\"{c}\":' || coalesce({text}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _fingerprint(cols: dict[str, bool], by: str = "") -> str:
    words = ", ".join(f"sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS s{i}" for i in range(4))
    text = "concat_ws('-', CAST(n AS VARCHAR), " + ", ".join(f"CAST(s{i} AS VARCHAR)" for i in range(4)) + ")"
    lead = f"{by}, " if by else ""
    return f"""WITH {TELEMETRY}, hashed AS (SELECT {lead}sha256({_json(cols)}) AS h FROM telemetry),
sums AS (SELECT {lead}count(*) AS n, {words} FROM hashed {'GROUP BY ' + by if by else ''})
SELECT {lead}n AS "rows", sha256({text}) AS fingerprint FROM sums"""


SQL["fingerprint_table"] = _fingerprint({"sample_index": False, "cpu_percent": True, "cpu_temp_celsius": True, "core_id": False})

_stats = [("count", "count({c})"), ("mean", "avg(CAST({c} AS DOUBLE))"), ("std", "stddev_samp(CAST({c} AS DOUBLE))"),
          ("min", "min({c})"), ("max", "max({c})")]


def _wide(source: str, name: str) -> str:
    cols = ", ".join(f"CAST({e.format(c=c)} AS DOUBLE) AS {c}_{s}" for c in ALL for s, e in _stats)
    return f"{name} AS (SELECT {', '.join(PROFILE_KEYS)}, {cols} FROM {source} GROUP BY ALL)"


_float = [c for c in TELEMETRY_COLUMNS if c in NUMERIC_COLUMNS and c != "process_count"]
SQL["fingerprint_groups"] = _fingerprint({c: c in _float for c in TELEMETRY_COLUMNS}, "core_id")
SQL["equal_within"] = f"""WITH {TELEMETRY}, {derived('DOUBLE', 'telemetry', 'd64')}, {derived('FLOAT', 'telemetry', 'd32')},
{_wide('d64', 'p64')}, {_wide('d32', 'p32')},
both_sides AS (SELECT {', '.join(f'a.{c}_{s} AS a_{c}_{s}, b.{c}_{s} AS b_{c}_{s}' for c in ALL for s, _ in _stats)}
  FROM p64 a JOIN p32 b USING ({', '.join(PROFILE_KEYS)})) """ + " UNION ALL ".join(
    f"SELECT '{c}_{s}' AS \"column\", count(*) AS cells, count(*) FILTER ("
    f"(a_{c}_{s} IS NULL AND b_{c}_{s} IS NULL) OR abs(a_{c}_{s} - b_{c}_{s}) <= 1e-6::DOUBLE + 1e-4::DOUBLE * abs(b_{c}_{s})) "
    f"AS equal_cells FROM both_sides" for c in ALL for s, _ in _stats)
SQL["small_groups"] = f"""WITH {TELEMETRY} SELECT disk_write_mb, net_recv_kb, process_count, count(*) AS n FROM telemetry
  GROUP BY ALL HAVING count(*) < 2"""

# --- experiment design -------------------------------------------------------
GRID = "grid AS (SELECT *, concat_ws('__', " + F5 + ") AS config_id FROM " + " CROSS JOIN ".join(
    f"(SELECT DISTINCT {f} FROM log)" for f in FACTORS) + ")"
SQL["design_grid"] = f"WITH {LOG}, {GRID} SELECT * FROM grid"


def _schedule(units: str, unit: str, blocks: int, seed: int) -> str:
    return f"""(SELECT {unit}, block, row_number() OVER (PARTITION BY block ORDER BY {hash_key(f'{seed} + block', unit)}, {unit}) AS position_in_block
  FROM ({units}) CROSS JOIN (SELECT CAST(unnest(range(1, {blocks + 1})) AS INTEGER) AS block))"""


SQL["block_schedule"] = f"WITH {LOG} SELECT * FROM {_schedule('SELECT DISTINCT config_id FROM log', 'config_id', 10, 42)}"
SQL["block_schedule_lines"] = f"SELECT * FROM {_schedule('SELECT DISTINCT l_orderkey AS unit FROM lineitem', 'unit', 3, 5)}"
SQL["pending_runs"] = f"""WITH {LOG}, moved AS (SELECT * REPLACE (block + (workers % 3) * 10 AS block) FROM log)
SELECT * FROM {_schedule('SELECT DISTINCT config_id FROM log', 'config_id', 20, 42)} s WHERE NOT EXISTS (
  SELECT 1 FROM moved m WHERE m.block = s.block AND m.config_id = s.config_id AND m.status = 'ok' AND m.energy_j > 20000)"""
SQL["latest_state"] = f"""WITH {LOG}, placed AS (SELECT *, row_number() OVER (PARTITION BY block, config_id
  ORDER BY status = 'ok' DESC, "timestamp" DESC, status DESC, energy_j DESC, runtime_s DESC) AS i FROM log)
SELECT block, config_id, status, "timestamp", energy_j, runtime_s FROM placed WHERE i = 1"""
SQL["select_configs"] = f"""WITH {LOG} SELECT config_id, count(*) AS runs FROM log
  WHERE engine IN ('A', 'R') AND data_format IN ('O') GROUP BY ALL"""


def _check(source: str, levels: dict[str, list[str]]) -> str:
    grid = " CROSS JOIN ".join(
        f"(SELECT unnest([{', '.join(repr(v) for v in vs)}]) AS {f})" for f, vs in levels.items())
    return f"""want AS (SELECT concat_ws('__', {F5}) AS config_id, block FROM {grid}
  CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS block)),
have AS (SELECT block, config_id, count(*) AS n FROM {source} GROUP BY ALL)
SELECT coalesce(w.block, h.block) AS block, coalesce(w.config_id, h.config_id) AS config_id, coalesce(n, 0) AS n,
  CASE WHEN w.config_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicated' ELSE 'ok' END AS state
FROM want w FULL JOIN have h ON w.block = h.block AND w.config_id = h.config_id"""


_wrong = {**LEVELS, "engine": ["A", "N", "X"]}
SQL["check_design"] = f"WITH {DESIGN}, part AS (SELECT * REPLACE (CASE WHEN block = 3 AND engine = 'N' THEN 13 ELSE block END AS block) FROM design), {_check('part', LEVELS)}"
SQL["check_design_log"] = f"WITH {LOG}, {_check('log', _wrong)}"
SQL["design_summary"] = f"""WITH {DESIGN} SELECT count(DISTINCT config_id) AS configs, count(DISTINCT block) AS blocks,
  count(*) AS "rows", count(*) = 480 AND count(DISTINCT config_id || '/' || block) = 480 AS passed, 48 AS expected_configs,
  10 AS expected_blocks, 480 AS expected_rows FROM design"""
SQL["check_levels"] = f"""WITH {LOG}, want AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, '{v}' AS level" for f, vs in _wrong.items() for v in vs) + "), have AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{f}' AS factor, {f} AS level FROM log" for f in FACTORS) + """)
SELECT coalesce(w.factor, h.factor) AS factor, coalesce(w.level, h.level) AS level,
  CASE WHEN h.level IS NULL THEN 'missing' WHEN w.level IS NULL THEN 'extra' ELSE 'ok' END AS state
FROM want w FULL JOIN have h ON w.factor = h.factor AND w.level = h.level"""
SQL["check_workers"] = f"""WITH {LOG}, flagged AS (SELECT execution_mode,
  CASE WHEN execution_mode = 'single' THEN workers = 1 ELSE workers > 1 END AS good FROM log)
SELECT execution_mode, count(*) AS "rows", bool_and(good) AS passed, bool_or(NOT good) AS any_bad FROM flagged GROUP BY ALL"""
SQL["failed_and_invalid_runs"] = f"""WITH {LOG} SELECT 'failed' AS kind, config_id, count(*) AS runs FROM log WHERE status <> 'ok' GROUP BY ALL
UNION ALL SELECT 'invalid', config_id, count(*) FROM log WHERE energy_j <= 0 OR runtime_s <= 0 OR peak_rss_mb - 100 <= 0 GROUP BY ALL"""
_audit = """SELECT config_id, count(DISTINCT rows_in) AS n_unique_rows_in, count(DISTINCT rows_out) AS n_unique_rows_out,
  count(DISTINCT result_hash) AS n_unique_hashes FROM log GROUP BY ALL"""
SQL["functional_audit"] = f"WITH {LOG} {_audit}"
SQL["unstable_hashes"] = f"""WITH {LOG}, audit AS ({_audit}) SELECT * FROM audit WHERE n_unique_hashes > 1
  ORDER BY n_unique_hashes DESC, config_id LIMIT 30"""


# --- descriptive tables ------------------------------------------------------
r = rounded_sql


def _describe(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", {r(f'avg({c})')} AS "mean", {r(f'stddev_samp({c})')} AS std,
  {r(f'min({c})')} AS "min", {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
  {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS "max", {r(f'median({c})')} AS "median",
  {r(f'100 * stddev_samp({c}) / avg({c})')} AS cv_percent FROM {source}""" for c in OUTCOMES)


SQL["describe_runs"] = f"WITH {LOG} {_describe('ok')}"
SQL["describe_design"] = f"WITH {DESIGN} {_describe('design')}"
_short = [("energy", "energy_j"), ("runtime", "runtime_s"), ("memory", "peak_rss_mb")]
T9 = "2.2621571627982036::DOUBLE"  # t quantile at 0.975 for n = 10
SQL["config_summary"] = f"""WITH {DESIGN}, g AS (SELECT config_id, {F5}, count(*) AS n, avg(energy_j) AS e, """ + ", ".join(
    f"{r(f'avg({c})')} AS {s}_mean, {r(f'median({c})')} AS {s}_median, {r(f'stddev_samp({c})')} AS {s}_sd" for s, c in _short) + f""",
  {r('min(energy_j)')} AS energy_min, {r('max(energy_j)')} AS energy_max,
  {r('stddev_samp(energy_j) / sqrt(count(*))')} AS energy_se, {r(T9)} AS t_crit_95,
  {r(f'avg(energy_j) - {T9} * stddev_samp(energy_j) / sqrt(count(*))')} AS energy_ci95_low,
  {r(f'avg(energy_j) + {T9} * stddev_samp(energy_j) / sqrt(count(*))')} AS energy_ci95_high,
  {r('100 * stddev_samp(energy_j) / avg(energy_j)')} AS energy_cv_percent
  FROM design GROUP BY ALL)
SELECT * EXCLUDE (e), CAST(row_number() OVER (ORDER BY e, config_id) AS INTEGER) AS energy_rank FROM g"""
SQL["summarize_runs"] = f"""WITH {LOG}, g AS (SELECT {F5}, config_id, avg(energy_j) AS e, avg(runtime_s) AS t, """ + ", ".join(
    f"{r(f'avg({c})')} AS {c}_mean, {r(f'median({c})')} AS {c}_median, {r(f'stddev_samp({c})')} AS {c}_std" for c in OUTCOMES) + """,
  count(block) AS measured_runs FROM ok GROUP BY ALL)
SELECT * EXCLUDE (e, t), CAST(row_number() OVER (ORDER BY e, t, config_id) AS INTEGER) AS energy_rank FROM g"""
SQL["engine_summary"] = f"""WITH {LOG} SELECT engine, count(*) AS n, {r('avg(energy_j)')} AS mean_energy, {r('median(energy_j)')} AS median_energy,
  {r('stddev_samp(energy_j)')} AS sd_energy, {r('avg(runtime_s)')} AS mean_runtime, {r('avg(peak_rss_mb)')} AS mean_memory FROM ok GROUP BY ALL"""
SQL["main_effects"] = f"WITH {LOG} " + " UNION ALL ".join(
    f"""SELECT '{f}' AS factor, {f} AS level, count(*) AS n, {r('avg(energy_j)')} AS energy_mean, {r('median(energy_j)')} AS energy_median,
  {r('stddev_samp(energy_j)')} AS energy_sd, {r('avg(runtime_s)')} AS runtime_mean, {r('avg(peak_rss_mb)')} AS memory_mean FROM ok GROUP BY ALL"""
    for f in FACTORS[1:])
SQL["block_summary"] = f"""WITH {LOG} SELECT block, {r('avg(energy_j)')} AS energy_mean, {r('median(energy_j)')} AS energy_median,
  {r('avg(runtime_s)')} AS runtime_mean, {r('avg(peak_rss_mb)')} AS memory_mean FROM ok GROUP BY ALL"""


def _where(condition: str, c: str = "energy_j") -> str:
    return r(f"avg({c}) FILTER (WHERE {condition})")


SQL["interaction_means"] = f"WITH {LOG} SELECT engine, " + ", ".join(
    _where(f"execution_mode = '{v}'") + f" AS \"{v}\"" for v in LEVELS["execution_mode"]) + " FROM ok GROUP BY ALL"
SQL["factor_level_matrix"] = f"WITH {LOG} SELECT engine, {r('avg(energy_j)')} AS overall, " + ", ".join(
    _where(f"{f} = '{v}'") + f" AS {f}_{v}" for f in FACTORS[1:] for v in LEVELS[f]) + " FROM ok GROUP BY ALL"
SQL["crosstab_workers"] = f"""WITH {LOG} SELECT execution_mode, count(*) FILTER (workers = 1) AS "1",
  count(*) FILTER (workers = 4) AS "4" FROM log GROUP BY ALL"""
MEANS = """means AS (SELECT config_id, avg(energy_j) AS energy_mean, avg(runtime_s) AS runtime_mean, avg(peak_rss_mb) AS memory_mean
  FROM {source} GROUP BY ALL)"""
SQL["best_worst"] = f"""WITH {LOG}, {MEANS.format(source='ok')},
b AS (SELECT * FROM means ORDER BY energy_mean, config_id LIMIT 1), w AS (SELECT * FROM means ORDER BY energy_mean DESC, config_id LIMIT 1)
SELECT b.config_id AS best_config, w.config_id AS worst_config, """ + ", ".join(
    f"{r(f'{t}.{c}_mean')} AS {n}_{c}_mean" for n, t in (("best", "b"), ("worst", "w")) for c in ("energy", "runtime", "memory")) + ", " + ", ".join(
    f"{r(f'w.{c}_mean / b.{c}_mean')} AS {c}_ratio, {r(f'100 * (1 - b.{c}_mean / w.{c}_mean)')} AS {c}_reduction_pct"
    for c in ("energy", "runtime")) + " FROM b, w"
_rounded_means = f"config_id, {r('energy_mean')} AS energy_mean, {r('runtime_mean')} AS runtime_mean, {r('memory_mean')} AS memory_mean"
SQL["top_bottom_k"] = f"""WITH {LOG}, {MEANS.format(source='ok')}
SELECT *, 'lowest' AS side FROM (SELECT {_rounded_means} FROM means ORDER BY means.energy_mean, config_id LIMIT 10)
UNION ALL SELECT *, 'highest' FROM (SELECT {_rounded_means} FROM means ORDER BY means.energy_mean DESC, config_id LIMIT 10)"""


def _histogram(value: str) -> str:
    return f"""WITH {LOG}, v AS (SELECT {value} AS x FROM ok), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(i AS INTEGER) AS bin, i * ((hi - lo) / 40) + lo AS bin_low,
  CASE WHEN i = 39 THEN hi ELSE (i + 1) * ((hi - lo) / 40) + lo END AS bin_high FROM e, (SELECT unnest(range(0, 40)) AS i))
SELECT bin, {r('bin_low')} AS bin_low, {r('bin_high')} AS bin_high,
  (SELECT count(*) FROM v WHERE x >= bin_low AND (x < bin_high OR (bin = 39 AND x = bin_high))) AS n FROM b"""


SQL["histogram"] = _histogram("energy_j")
SQL["histogram_log10"] = _histogram("log10(energy_j)")
SQL["power_edp"] = f"""WITH {LOG} SELECT config_id, block, energy_j / runtime_s AS avg_power_w, energy_j * runtime_s AS edp_j_s FROM log"""
SQL["derived_summary"] = f"""WITH {LOG} SELECT config_id, {F5}, {r('avg(energy_j)')} AS mean_energy, {r('avg(runtime_s)')} AS mean_runtime,
  {r('avg(peak_rss_mb)')} AS mean_memory, {r('avg(energy_j / runtime_s)')} AS mean_power, {r('avg(energy_j * runtime_s)')} AS mean_edp
  FROM ok GROUP BY ALL"""
MG = "/ 3600000e0 * 62e-2 * 1e3 * 1e3"
SQL["carbon_totals"] = f"""WITH {LOG} SELECT count(*) AS runs, {r('sum(energy_j) / 1e3')} AS total_kj, {r('sum(energy_j) / 3600000e0')} AS total_kwh,
  {r('sum(energy_j) / 3600000e0 * 62e-2 * 1e3')} AS total_co2_g, {r('avg(energy_j)')} AS mean_j, {r('median(energy_j)')} AS median_j,
  {r(f'min(energy_j) {MG}')} AS co2_mg_min, {r(f'median(energy_j) {MG}')} AS co2_mg_median,
  {r(f'avg(energy_j) {MG}')} AS co2_mg_mean, {r(f'max(energy_j) {MG}')} AS co2_mg_max FROM ok"""
SQL["carbon_by_config"] = f"WITH {LOG}, {MEANS.format(source='ok')} SELECT config_id, {r(f'energy_mean {MG}')} AS co2_mg FROM means"
SQL["scatter_bins"] = f"""WITH {LOG}, e AS (SELECT min(runtime_s) AS xl, max(runtime_s) AS xh, min(energy_j) AS yl, max(energy_j) AS yh FROM ok)
SELECT CAST(least(floor((runtime_s - xl) / (xh - xl) * 32), 31) AS INTEGER) AS x_bin,
  CAST(least(floor((energy_j - yl) / (yh - yl) * 32), 31) AS INTEGER) AS y_bin, count(*) AS n FROM ok, e GROUP BY ALL"""

# --- models: every term of a 3 x 2 x 2 x 2 x 2 factorial in closed form -------
# s = product of +-1 signs of the two-level factors in the term; a term with
# the engine compares the signed sums of the engines, weighted by precision.
TWO = FACTORS[1:]
_sign = {f: f"(CASE WHEN {f} = '{LEVELS[f][0]}' THEN 1 ELSE -1 END)" for f in TWO}


def _terms(cells: str, columns: str = "") -> str:
    """d(engine, term) over a cell table (engine, two-level factors, n, m)."""
    subsets = [s for k in range(5) for s in combinations(TWO, k)]
    lead = f"{columns}, " if columns else ""
    signed = " UNION ALL ".join(
        f"SELECT {lead}engine, '{':'.join(s)}' AS sub, sum({' * '.join([_sign[f] for f in s] or ['1'])} * m) AS d, "
        f"sum(1e0 / n) AS v FROM {cells} GROUP BY ALL" for s in subsets)
    return f"""signed AS ({signed}),
terms AS (
  SELECT {lead}sub AS term, 1e0 AS df, pow(sum(d), 2) / sum(v) AS ss FROM signed WHERE sub <> '' GROUP BY ALL
  UNION ALL SELECT {lead}CASE WHEN sub = '' THEN 'engine' ELSE 'engine:' || sub END AS term, 2e0 AS df,
    sum(d * d / v) - pow(sum(d / v), 2) / sum(1e0 / v) AS ss FROM signed GROUP BY {lead}sub)"""


# a run table whose energy_j is another outcome
def _as_energy(outcome: str) -> str:
    return DESIGN.replace("design AS (", "design0 AS (").rstrip() + (
        f", design AS (SELECT * REPLACE ({outcome} AS energy_j) FROM design0)")


CELLS = f"cells AS (SELECT {F5}, count(*) AS n, avg(energy_j) AS m, var_pop(energy_j) * count(*) AS ss FROM {{source}} GROUP BY ALL)"
RES = """fitted_rows AS (SELECT *, avg(energy_j) OVER (PARTITION BY config_id) + avg(energy_j) OVER (PARTITION BY block)
    - avg(energy_j) OVER () AS fit FROM design),
rss AS (SELECT sum(pow(energy_j - fit, 2)) AS rss, count(*) - 47 - count(DISTINCT block) AS rdf, var_pop(energy_j) * count(*) AS tss FROM fitted_rows),
blocks AS (SELECT 'block' AS term, CAST(count(*) - 1 AS DOUBLE) AS df, sum(48 * pow(bm - g, 2)) AS ss FROM
  (SELECT block, avg(energy_j) AS bm, (SELECT avg(energy_j) FROM design) AS g FROM design GROUP BY block))"""
def _type3(design: str = DESIGN) -> str:
    return f"WITH {design}, {CELLS.format(source='design')}, {_terms('cells')}, {RES}, every AS (SELECT * FROM terms UNION ALL SELECT * FROM blocks)"


_balanced = _type3()
_effect = f"term, df, {r('(ss / df) / (rss / rdf)')} AS f, {r('ss / (ss + rss)')} AS partial_eta2"
SQL["type3_anova"] = f"{_balanced} SELECT {_effect} FROM every, rss"
def _p_of(query: str, keep: str) -> str:
    """keep and p_value of a query that gives them with f, d1 and d2."""
    return f"SELECT {keep}, {r('p')} AS p_value FROM ({f_tail(query, keep)})"


SQL["type3_anova_p"] = _p_of(" UNION ALL ".join(
    f"SELECT * FROM ({_type3(_as_energy(c))} SELECT '{c}' AS outcome, term, df, (ss / df) / (rss / rdf) AS f, df AS d1, rdf AS d2 FROM every, rss)"
    for c in OUTCOMES), "outcome, term, df")
SQL["type3_anova_outcomes"] = " UNION ALL ".join(
    f"SELECT * FROM ({_type3(_as_energy(c))} SELECT '{c}' AS outcome, {_effect} FROM every, rss)" for c in OUTCOMES)
SQL["partial_eta2_ranked"] = f"""{_balanced}, eta AS (SELECT term, ss / (ss + rss) AS e FROM every, rss)
SELECT term, {r('e')} AS partial_eta2, CASE WHEN e >= 0.14 THEN 'large' WHEN e >= 0.06 THEN 'medium' WHEN e >= 0.01 THEN 'small'
  ELSE 'very small' END AS eta2_interpretation FROM eta"""
SQL["model_fit"] = f"""WITH {DESIGN}, {RES} SELECT 480e0 AS n, CAST(rdf AS DOUBLE) AS df_resid, {r('1 - rss / tss')} AS r_squared,
  {r('sqrt(rss / rdf)')} AS rmse FROM rss"""
SQL["interpretation"] = f"""{_balanced}, g AS (SELECT config_id, avg(energy_j) AS e, {T9} * stddev_samp(energy_j) / sqrt(count(*)) AS h,
  avg(runtime_s) AS t, avg(peak_rss_mb) AS m FROM design GROUP BY ALL), best AS (SELECT * FROM g ORDER BY e, config_id LIMIT 1),
eta AS (SELECT term, ss / (ss + rss) AS e FROM every, rss), top AS (SELECT * FROM eta ORDER BY e DESC, term LIMIT 10)
""" + " UNION ALL ".join(
    f"SELECT 'best configuration' AS kind, '{n}' AS name, {r(x)} AS \"value\", config_id AS label FROM best" for n, x in (
        ("mean energy (J)", "e"), ("95% low", "e - h"), ("95% high", "e + h"), ("mean runtime (s)", "t"), ("mean peak memory (MB)", "m"))) + f"""
UNION ALL SELECT 'effect', term, {r('e')}, CASE WHEN e >= 0.14 THEN 'large' WHEN e >= 0.06 THEN 'medium' WHEN e >= 0.01 THEN 'small'
  ELSE 'very small' END FROM top"""
SQL["type3_unbalanced"] = f"""WITH {LOG}, {CELLS.format(source='ok')}, {_terms('cells')},
rss AS (SELECT sum(ss) AS rss, sum(n) - 48 AS rdf FROM cells)
SELECT {_effect} FROM terms, rss"""
# with blocks in an unbalanced log there is no closed form: the equations are solved
COLUMNS = Columns(LEVELS)
_every_outcome = " UNION ALL ".join(f"SELECT '{c}' AS target, block, {F5}, {c} AS y FROM ok" for c in OUTCOMES)
_unbalanced = f"WITH RECURSIVE {LOG}, src AS ({_every_outcome}), {COLUMNS.swept('src')}, every AS MATERIALIZED ({COLUMNS.sums('fit')})"
_tails = f_tail("SELECT target, term, (ss / df) / (rss / rdf) AS f, df AS d1, rdf AS d2 FROM every", "target, term")
SQL["type3_unbalanced_blocks"] = f"""{_unbalanced}, tails AS ({_tails})
SELECT target AS outcome, term, df, {r('log10(ss)', 5)} AS log_ss, {r('log10((ss / df) / (rss / rdf))', 5)} AS log_f, {r('p')} AS p_value,
  CASE WHEN term <> 'Intercept' THEN {r('ss / (ss + rss)')} END AS partial_eta2 FROM every JOIN tails USING (target, term)
UNION ALL SELECT DISTINCT target, 'Residual', CAST(rdf AS DOUBLE), {r('log10(rss)', 5)}, NULL, NULL, NULL FROM every"""
SQL["residuals"] = f"WITH {DESIGN}, {RES} SELECT block, config_id, {r('fit', 5)} AS fitted, {r('energy_j - fit', 5)} AS residual FROM fitted_rows"


# --- diagnostics -------------------------------------------------------------
def _levene(center: str) -> str:
    return f"""WITH {LOG}, c AS (SELECT config_id, {center}(energy_j) AS c FROM ok GROUP BY ALL),
z AS (SELECT config_id, abs(energy_j - c) AS z FROM ok JOIN c USING (config_id)),
g AS (SELECT config_id, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z GROUP BY ALL),
t AS (SELECT avg(z) AS gm FROM z)
SELECT (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f,
  CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2 FROM g, t"""


def _levene_row(query: str) -> str:
    return f"""SELECT {r('statistic')} AS statistic, df1, df2, {r('p')} AS p_value FROM (
  {f_tail(f"SELECT f AS statistic, d1 AS df1, d2 AS df2, f, d1, d2 FROM ({query})", "statistic, df1, df2")})"""


SQL["levene"] = _levene_row(_levene("avg"))
SQL["brown_forsythe"] = _levene_row(_levene("median"))


def _shapiro(lead: str, value: str, source: str) -> str:
    """W and p by Royston's approximation (n above 11); fixed values: its
    published polynomial coefficients."""
    def poly(x: str, *c: float) -> str:
        return " + ".join(f"({v!r}::DOUBLE) * pow({x}, {k})" for k, v in enumerate(c))

    outer = poly("u", 0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
    second = poly("u", 0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
    mean = poly("ln(n)", -1.5861, -0.31082, -0.083751, 0.0038915)
    sd = poly("ln(n)", -0.4803, -0.082676, 0.0030302)
    return f"""{lead}, s1 AS (SELECT x - avg(x) OVER () AS x, row_number() OVER (ORDER BY x) AS i, CAST(count(*) OVER () AS DOUBLE) AS n
  FROM (SELECT {value} AS x FROM {source})),
s2 AS (SELECT *, {normal_quantile('(i - 0.375e0) / (n + 0.25e0)')} AS m FROM s1),
s3 AS (SELECT any_value(n) AS n, sum(m * m) AS mm, sum(x * m) AS sxm, sum(x * x) AS ss, max(m) AS mn, max(m) FILTER (i = n - 1) AS mn1,
  max(x) - min(x) AS ends, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS nexts FROM s2),
s4 AS (SELECT *, 1 / sqrt(n) AS u FROM s3),
s5 AS (SELECT *, mn / sqrt(mm) + {outer} AS an, mn1 / sqrt(mm) + {second} AS an1 FROM s4),
s6 AS (SELECT n, pow(an * ends + an1 * nexts + (sxm - mn * ends - mn1 * nexts)
  / sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)), 2) / ss AS w FROM s5)
SELECT CAST(n AS BIGINT) AS n, w AS statistic, {normal_tail(f'(ln(1 - w) - ({mean})) / exp({sd})')} AS p, n > 5000 AS beyond_range FROM s6"""


_shapiro_row = f"SELECT {r('statistic')} AS statistic, {r('p')} AS p_value, n, beyond_range FROM "
SQL["shapiro_wilk"] = f"{_shapiro_row}({_shapiro(f'WITH {DESIGN}, {RES}', 'energy_j - fit', 'fitted_rows')})"
SQL["shapiro_wilk_log"] = f"{_shapiro_row}({_shapiro(f'WITH {LOG}', 'energy_j', 'ok')})"


def _assumptions(c: str) -> str:
    lead = f"WITH {_as_energy(c)}"
    spread = [(name, f"SELECT f AS statistic, p FROM ({f_tail('SELECT f AS keep, * FROM (' + _levene(center).replace(f'WITH {LOG}', lead).replace('FROM ok', 'FROM design') + ')', 'f')})")
              for name, center in (("Levene homogeneity", "avg"), ("Brown-Forsythe homogeneity", "median"))]
    normal = f"SELECT statistic, p FROM ({_shapiro(f'{lead}, {RES}', 'energy_j - fit', 'fitted_rows')})"
    return " UNION ALL ".join(f"SELECT '{c}' AS outcome, '{name}' AS diagnostic, statistic, p FROM ({query})"
                              for name, query in [("Shapiro-Wilk residual normality", normal), *spread])


SQL["assumption_summary"] = f"""WITH tests AS ({' UNION ALL '.join(_assumptions(c) for c in OUTCOMES)})
SELECT outcome, diagnostic, {r('statistic')} AS statistic, {r('p')} AS p_value, p < 0.05e0 AS rejected,
  CASE WHEN bool_or(p < 0.05e0 AND diagnostic NOT LIKE 'Levene%') OVER (PARTITION BY outcome) THEN 'aligned rank transform'
    ELSE 'original-scale factorial' END AS method FROM tests"""
SQL["qq_points"] = f"""WITH {LOG}, p AS (SELECT row_number() OVER (ORDER BY energy_j) AS "position", count(*) OVER () AS n,
  (energy_j - avg(energy_j) OVER ()) / stddev_pop(energy_j) OVER () AS sample FROM ok)
SELECT "position", {r(normal_quantile('"position" / (n + 1e0)'))} AS theoretical, {r('sample')} AS sample FROM p"""
SQL["tail_p"] = f"""WITH g AS (SELECT l_linenumber, l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY ALL),
t AS (SELECT *, pow(1e1, 3 + 10 * (l_linenumber - 1) / 6e0) AS d2, q / 10 AS f FROM g)
SELECT l_linenumber, l_returnflag, {r('p', 9)} AS p_value FROM ({f_tail("SELECT *, CASE l_returnflag WHEN 'A' THEN 1e0 WHEN 'N' THEN 2e0 ELSE 7e0 END AS d1 FROM t", "l_linenumber, l_returnflag")})"""
SQL["qq_samples"] = f"""WITH {LOG} SELECT row_number() OVER (ORDER BY energy_j) AS "position",
  {r('(energy_j - avg(energy_j) OVER ()) / stddev_pop(energy_j) OVER ()')} AS sample FROM ok"""


# --- aligned ranks -----------------------------------------------------------
def _marginal(subset: tuple[str, ...]) -> str:
    """Mean over a factor subset of the balanced design, per row."""
    part = f"PARTITION BY {', '.join(subset)}" if subset else ""
    return f"avg(energy_j) OVER ({part})"


def _art(design: str = DESIGN, digits: int = 5, columns: str = "") -> str:
    terms = [t for k in range(1, 6) for t in combinations(FACTORS, k)]
    subs = [s for k in range(6) for s in combinations(FACTORS, k)]
    name = {s: "m_" + "_".join(str(FACTORS.index(f)) for f in s) for s in subs}
    margins = ", ".join(f"{_marginal(s)} AS {name[s]}" for s in subs)
    rows = []
    for t in terms:
        effect = " ".join(
            f"{'+' if (len(t) - len(s)) % 2 == 0 else '-'} {name[s]}" for k in range(len(t) + 1) for s in combinations(t, k))
        rows.append(f"SELECT '{':'.join(t)}' AS target, block, {F5}, round(energy_j - {name[tuple(FACTORS)]} {effect}, {digits}) AS y FROM margins")
    return f"""WITH {design}, margins AS (SELECT *, {margins} FROM design),
aligned AS ({' UNION ALL '.join(rows)}),
ranked AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2e0 AS m0 FROM aligned),
cells AS (SELECT target, {F5}, count(*) AS n, avg(m0) AS m FROM ranked GROUP BY ALL),
{_terms('cells', 'target')},
fitted_rows AS (SELECT target, m0 - avg(m0) OVER (PARTITION BY target, {F5}) - avg(m0) OVER (PARTITION BY target, block)
    + avg(m0) OVER (PARTITION BY target) AS res FROM ranked),
rss AS (SELECT target, sum(res * res) AS rss, 423 AS rdf FROM fitted_rows GROUP BY ALL)
SELECT {columns or _effect} FROM terms JOIN rss ON rss.target = terms.target AND terms.term = rss.target"""


SQL["art_anova"] = _art()
SQL["art_anova_p"] = _p_of(_art(columns="term, df, (ss / df) / (rss / rdf) AS f, df AS d1, rdf AS d2"), "term, df")
SQL["art_anova_secondary"] = " UNION ALL ".join(
    f"SELECT *, '{c}' AS outcome FROM ({_art(_as_energy(c), 8)})" for c in OUTCOMES[1:])
# a random block: its variance decides which residual variance the terms are held against
_by_block = """rss AS (SELECT target, CASE WHEN ssb / 9 > rss / 423 THEN rss ELSE (rss + ssb) / 432 * 423 END AS rss, 423 AS rdf FROM
  (SELECT target, sum(res * res) AS rss FROM fitted_rows GROUP BY ALL) JOIN
  (SELECT target, sum(48 * pow(bm - g, 2)) AS ssb FROM (SELECT target, block, avg(m0) AS bm FROM ranked GROUP BY ALL)
    JOIN (SELECT target, avg(m0) AS g FROM ranked GROUP BY ALL) USING (target) GROUP BY target) USING (target))"""


def _mixed(query: str) -> str:
    told = query.replace("rss AS (SELECT target, sum(res * res) AS rss, 423 AS rdf FROM fitted_rows GROUP BY ALL)", _by_block)
    assert told != query
    return told


SQL["art_mixed"] = " UNION ALL ".join(f"SELECT *, '{c}' AS outcome FROM ({_mixed(_art(_as_energy(c), 5 if c == 'energy_j' else 8))})" for c in OUTCOMES)
_effects = " UNION ALL ".join(
    f"SELECT '{t}' AS target, {F5}, " + " + ".join(f"m[{p + i}][{COLUMNS.y}] * {COLUMNS.x[p + i - 1]}" for i in range(w)) + " AS effect FROM cells0, fit0"
    for t, p, w in COLUMNS.terms)
SQL["art_unbalanced"] = f"""WITH RECURSIVE {LOG}, src0 AS (SELECT 'y' AS target, block, {F5}, energy_j AS y FROM ok), {COLUMNS.swept('src0', '0')},
cells0 AS (SELECT DISTINCT {F5} FROM ok), effects AS ({_effects}), all_effects AS (SELECT {F5}, sum(effect) AS whole FROM effects GROUP BY ALL),
aligned AS (SELECT e.target, ok.block, {', '.join(f'ok.{f}' for f in FACTORS)}, round(energy_j + (effect - whole - constant), 5) AS v
  FROM (SELECT {COLUMNS.constant} AS constant FROM fit0), ok JOIN all_effects USING ({F5}) JOIN effects e USING ({F5})),
src AS (SELECT target, block, {F5}, rank() OVER (PARTITION BY target ORDER BY v) + (count(*) OVER (PARTITION BY target, v) - 1) / 2e0 AS y FROM aligned),
{COLUMNS.swept('src')}, every AS ({COLUMNS.sums('fit', "target = '{term}'")})
SELECT {_effect} FROM every"""
# an aligned term sums to zero and carries its own effect only
_alignment = _art().split("ranked AS (")[0]
SQL["art_alignment_check"] = f"""{_alignment} cells AS (SELECT target, {F5}, count(*) AS n, avg(y) AS m FROM aligned GROUP BY ALL),
{_terms('cells', 'target')}, sums AS (SELECT target, sum(y) AS total FROM aligned GROUP BY ALL),
raw AS (SELECT term, ss FROM (WITH {DESIGN}, {CELLS.format(source='design')}, {_terms('cells')} SELECT * FROM terms)),
own AS (SELECT target, max(ss) FILTER (term = target) AS own, max(ss) FILTER (term <> target) AS other FROM terms GROUP BY ALL)
SELECT own.target, {r('total / 1e4', 3)} AS aligned_sum, {r('own / ss', 3)} AS target_share, {r('other / ss', 3)} AS largest_other_share,
  other <= 1e-9 * ss AND abs(total) < 1e-2 AS ok FROM own JOIN sums USING (target) JOIN raw ON raw.term = own.target"""
SQL["artc_engine_pairwise"] = f"""WITH {DESIGN}, aligned AS (SELECT *, round(energy_j - avg(energy_j) OVER (PARTITION BY config_id)
    + avg(energy_j) OVER (PARTITION BY engine), 5) AS y FROM design),
ranked AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS r FROM aligned),
rss AS (SELECT sum(pow(r - c - b + g, 2)) / 423 AS mse FROM (SELECT r, avg(r) OVER (PARTITION BY config_id) AS c,
  avg(r) OVER (PARTITION BY block) AS b, avg(r) OVER () AS g FROM ranked)),
lv AS (SELECT engine, avg(r) AS m, count(*) AS n FROM ranked GROUP BY ALL)
SELECT a.engine || ' - ' || b.engine AS contrast, {r('a.m - b.m')} AS estimate, {r('sqrt(mse * (1e0 / a.n + 1e0 / b.n))')} AS se,
  423e0 AS df, {r('(a.m - b.m) / sqrt(mse * (1e0 / a.n + 1e0 / b.n))')} AS t_ratio
FROM lv a JOIN lv b ON a.engine < b.engine, rss"""


def _holm(query: str, keep: str, family: str = "") -> str:
    """Two-sided p values of t_ratio on df, and Holm's over each family."""
    tails = f_tail(f"SELECT *, t_ratio * t_ratio AS f, 1e0 AS d1, df AS d2 FROM ({query})", keep)
    part = f"PARTITION BY {family} " if family else ""
    return f"""WITH tails AS ({tails}), steps AS (SELECT *, least(1e0, (count(*) OVER ({part}) - row_number() OVER ({part}ORDER BY p) + 1) * p) AS q FROM tails)
SELECT {keep}, {r('p')} AS p_value, {r(f'max(q) OVER ({part}ORDER BY p ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM steps"""


def _within(f: str) -> str:
    return f"""SELECT * FROM (WITH {DESIGN}, aligned AS (SELECT *, round(energy_j - avg(energy_j) OVER (PARTITION BY config_id)
    + avg(energy_j) OVER (PARTITION BY engine, {f}), 5) AS y FROM design),
ranked AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS r FROM aligned),
rss AS (SELECT sum(pow(r - c - b + g, 2)) / 423 AS mse FROM (SELECT r, avg(r) OVER (PARTITION BY config_id) AS c,
  avg(r) OVER (PARTITION BY block) AS b, avg(r) OVER () AS g FROM ranked)),
lv AS (SELECT engine, {f} AS lev, avg(r) AS m, count(*) AS n FROM ranked GROUP BY ALL)
SELECT '{f}' AS factor, a.engine, a.engine || ',' || a.lev || ' - ' || b.engine || ',' || b.lev AS contrast, {r('a.m - b.m')} AS estimate,
  {r('sqrt(mse * (1e0 / a.n + 1e0 / b.n))')} AS se, 423e0 AS df, {r('(a.m - b.m) / sqrt(mse * (1e0 / a.n + 1e0 / b.n))')} AS t_ratio
FROM lv a JOIN lv b ON a.engine = b.engine AND a.lev = '{LEVELS[f][0]}' AND b.lev = '{LEVELS[f][1]}', rss)"""


SQL["artc_within_engine"] = " UNION ALL ".join(_within(f) for f in FACTORS[1:])
SQL["artc_engine_pairwise_holm"] = _holm(SQL["artc_engine_pairwise"].replace(r('(a.m - b.m) / sqrt(mse * (1e0 / a.n + 1e0 / b.n))'), "(a.m - b.m) / sqrt(mse * (1e0 / a.n + 1e0 / b.n))"), "contrast")
SQL["artc_within_engine_holm"] = _holm(SQL["artc_within_engine"].replace(r('(a.m - b.m) / sqrt(mse * (1e0 / a.n + 1e0 / b.n))'), "(a.m - b.m) / sqrt(mse * (1e0 / a.n + 1e0 / b.n))"), "factor, engine, contrast", "factor")
SQL["holm_adjust"] = f"""WITH {LOG}, p AS (SELECT engine, config_id, CAST(CAST(sum(runtime_s) AS BIGINT) % 997 AS DOUBLE) / 2e4 AS p_value FROM ok GROUP BY ALL),
s AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY engine) - row_number() OVER (PARTITION BY engine ORDER BY p_value) + 1) * p_value) AS q FROM p)
SELECT engine, config_id, {r('p_value')} AS p_value, {r('max(q) OVER (PARTITION BY engine ORDER BY p_value ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM s"""

# --- relations ---------------------------------------------------------------
SQL["corr_pearson"] = f"WITH {LOG} SELECT count(*) AS n, {r('corr(energy_j, runtime_s)')} AS statistic FROM ok"


def _avg_rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0"


SQL["corr_spearman"] = f"""WITH {LOG}, k AS (SELECT {_avg_rank('energy_j')} AS a, {_avg_rank('runtime_s')} AS b FROM ok)
SELECT count(*) AS n, {r('corr(a, b)')} AS statistic FROM k"""
_corr = " UNION ALL ".join(
    f"SELECT '{level}' AS level, '{method}' AS method, count(*) AS n, {r('corr(a, b)')} AS statistic FROM {table}"
    for level, method, table in (
        ("run-level", "Pearson", "(SELECT energy_j AS a, runtime_s AS b FROM ok)"),
        ("run-level", "Spearman", f"(SELECT {_avg_rank('energy_j')} AS a, {_avg_rank('runtime_s')} AS b FROM ok)"),
        ("configuration-mean", "Pearson", "(SELECT energy_mean AS a, runtime_mean AS b FROM means)"),
        ("configuration-mean", "Spearman",
         f"(SELECT {_avg_rank('energy_mean')} AS a, {_avg_rank('runtime_mean')} AS b FROM means)")))
SQL["correlations"] = f"WITH {LOG}, {MEANS.format(source='ok')} {_corr}"
SQL["correlations_p"] = _p_of(f"""SELECT level, method, n, statistic * statistic * (n - 2) / (1 - statistic * statistic) AS f, 1e0 AS d1, n - 2e0 AS d2
FROM (WITH {LOG}, {MEANS.format(source='ok')} {_corr.replace(r('corr(a, b)'), 'corr(a, b)')})""", "level, method, n")
SQL["average_ranks"] = f"""WITH {LOG}, k AS (SELECT engine, runtime_s AS "value", rank() OVER (PARTITION BY engine ORDER BY runtime_s) AS m,
  count(*) OVER (PARTITION BY engine) AS total FROM ok)
SELECT engine, "value", count(*) AS n, m AS min_rank, m + (count(*) - 1) / 2e0 AS avg_rank, total FROM k GROUP BY engine, "value", m, total"""


def _pareto(source: str, cols: list[str]) -> str:
    below = " AND ".join(f"q.{c} <= p.{c}" for c in cols)
    strict = " OR ".join(f"q.{c} < p.{c}" for c in cols)
    return f"NOT EXISTS (SELECT 1 FROM {source} q WHERE {below} AND ({strict}))"


SQL["pareto_2d"] = f"""WITH {LOG}, pts AS (SELECT DISTINCT energy_j, runtime_s FROM ok),
f AS (SELECT * FROM pts p WHERE {_pareto('pts', ['energy_j', 'runtime_s'])})
SELECT config_id, block, energy_j, runtime_s, true AS pareto FROM ok JOIN f USING (energy_j, runtime_s)"""
SQL["pareto_3d"] = f"""WITH {LOG}, rows3 AS (SELECT config_id, block, energy_j, -runtime_s AS slack, peak_rss_mb FROM ok),
pts AS (SELECT slack, peak_rss_mb, min(energy_j) AS energy_j FROM rows3 GROUP BY ALL),
f AS (SELECT * FROM pts p WHERE {_pareto('pts', ['energy_j', 'slack', 'peak_rss_mb'])})
SELECT config_id, block, energy_j, slack, peak_rss_mb, true AS pareto FROM rows3 JOIN f USING (energy_j, slack, peak_rss_mb)"""
SQL["pareto_configs"] = f"""WITH {DESIGN}, {MEANS.format(source='design')}
SELECT config_id, {_pareto('means', ['energy_mean', 'runtime_mean'])} AS pareto_energy_runtime,
  {_pareto('means', ['energy_mean', 'runtime_mean', 'memory_mean'])} AS pareto_energy_runtime_memory FROM means p"""
SQL["position_drift"] = f"""WITH {DESIGN}, {RES}, k AS (SELECT row_number() OVER (PARTITION BY block ORDER BY {hash_key('block', 'config_id')}, config_id) AS pos,
  energy_j - fit AS res FROM fitted_rows),
ranks AS (SELECT {_avg_rank('pos')} AS a, {_avg_rank('res')} AS b FROM k)
SELECT n, {r('rho')} AS spearman_rho, {r('p')} AS p_value FROM ({f_tail("SELECT n, rho, rho * rho * (n - 2) / (1 - rho * rho) AS f, 1e0 AS d1, n - 2e0 AS d2 FROM (SELECT count(*) AS n, corr(a, b) AS rho FROM ranks)", "n, rho")})"""
LOO = f"""cb AS (SELECT config_id, block, sum(energy_j) AS s, count(*) AS n FROM ok GROUP BY ALL),
tot AS (SELECT config_id, sum(s) AS ts, sum(n) AS tn FROM cb GROUP BY ALL),
full_best AS (SELECT config_id FROM tot ORDER BY ts / tn, config_id LIMIT 1),
rest AS (SELECT b.block, o.config_id, avg(energy_j) AS m FROM (SELECT DISTINCT block FROM ok) b JOIN ok o ON o.block <> b.block GROUP BY ALL),
placed AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY m) AS k, row_number() OVER (PARTITION BY block ORDER BY m, config_id) AS i FROM rest),
loo AS (SELECT a.block AS excluded_block, a.config_id AS best_config_after_exclusion, {r('a.m')} AS best_mean_energy_after_exclusion,
  f.config_id AS full_sample_best_config, CAST(p.k AS INTEGER) AS rank_of_full_sample_best
  FROM placed a, full_best f JOIN placed p ON p.config_id = f.config_id WHERE a.i = 1 AND p.block = a.block)"""
SQL["leave_one_block_out"] = f"WITH {LOG}, {LOO} SELECT * FROM loo"
SQL["best_stability"] = f"WITH {LOG}, {LOO} SELECT count(*) FILTER (rank_of_full_sample_best = 1) AS kept_rank_1, count(*) AS exclusions FROM loo"
