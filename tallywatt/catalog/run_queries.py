"""Queries over run logs built from ``lineitem``.

``log`` has one run per line (unbalanced, some rows failed); ``design`` has
one run per configuration and block whose outcomes average all its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatt.catalog.registry import query
from tallywatt.catalog.rounding import rounded
from tallywatt.catalog.telemetry_queries import run_folder, telemetry
from tallywatt.operators import anova, art, clean, design as D, diagnostics as G, quality as Q, relations as R, summary as S
from tallywatt.functions.dist_columns import f_tail
from tallywatt.operators import profile as P
from tallywatt.operators.features import derive
from tallywatt.schema import OUTCOMES
from tallywatt.sources import adapters as A, sinks
from tallywatt.sources.tables import count_rows, lineitem, read_if_exists, read_runs

LEVELS = {
    "engine": ["A", "N", "R"],
    "data_format": ["F", "O"],
    "numeric_dtype": ["0", "1"],
    "categorical_dtype": ["0", "1"],
    "execution_mode": ["single", "parallel"],
}
BLOCKS = range(1, 11)
BINARY = list(LEVELS)[1:]
BINS = 40


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_log_from_lineitem(lineitem(spark, sf_dir))


def ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.ok_runs(log(spark, sf_dir))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.design_from_lineitem(lineitem(spark, sf_dir))


# --- samples -----------------------------------------------------------------

@query
def sample_first(spark, sf_dir):
    return D.first_n(telemetry(spark, sf_dir), 500).select("sample_index", "cpu_percent", "core_id")


@query
def sample_random(spark, sf_dir):
    return D.random_n(telemetry(spark, sf_dir), 500, seed=7).select("sample_index", "cpu_percent", "core_id")


@query
def sample_first_large(spark, sf_dir):
    """More rows than a top-n holds, by a key with nulls and ties."""
    lines = lineitem(spark, sf_dir).select(
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("k"), "l_orderkey", "l_linenumber", "l_partkey")
    return D.first_n(lines, 25_000, order="k")


@query
def sample_random_large(spark, sf_dir):
    lines = lineitem(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_extendedprice")
    return D.random_n(lines, 12_000, seed=3, unit="line")


@query
def stored_subset(spark, sf_dir):
    """A subset that was stored, found again and read back."""
    source = f"{sf_dir}/lineitem.parquet"
    rows = lineitem(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("sample_index"),
                                          "l_partkey", "l_quantity")
    folder = run_folder(spark)
    sinks.stored_subset(rows, folder, source, 3000)
    found = sinks.stored_subset(rows.limit(0), folder, source, 3000)
    return spark.read.parquet(found["parquet_path"])


@query
def run_log_read_back(spark, sf_dir):
    """Runs appended to a log in two goes, read by name and normalised."""
    folder, rows = run_folder(spark), log(spark, sf_dir)
    for part in (rows.filter("status = 'ok'"), rows.filter("status <> 'ok'")):
        sinks.append_runs(part, f"{folder}/runs.csv")
    runs = clean.normalise_runs(read_runs(spark, f"{folder}/runs.csv"))
    return runs.groupBy("engine", "execution_mode").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.round(F.col("energy_j") * 100).cast("long")).alias("cents"))


@query
def run_metadata(spark, sf_dir):
    path = f"{run_folder(spark)}/metadata.json"
    sinks.run_metadata(design(spark, sf_dir), path, {"seed": 42})
    return spark.read.json(path)


@query
def write_result(spark, sf_dir):
    """A result table in its order, read back with the number of its line."""
    table = ok(spark, sf_dir).groupBy("config_id").agg(F.count(F.lit(1)).alias("runs"))
    path = sinks.write_result(table, run_folder(spark), "runs", order=["config_id"])
    return spark.read.option("header", True).schema("config_id string, runs long").csv(path)


@query
def level_order(spark, sf_dir):
    """The order of the levels found in the log."""
    return D.level_order(spark, anova.observed_levels(log(spark, sf_dir)))


@query
def optional_tables(spark, sf_dir):
    """Rows of the tables that are there; an absent one gives none."""
    out = None
    for name in ("orders", "supplier", "absent"):
        table = read_if_exists(spark, f"{sf_dir}/{name}.parquet")
        rows = F.lit(None if table is None else count_rows(table)).cast("long")
        row = spark.range(1).select(F.lit(name).alias("name"), rows.alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


# --- data quality ------------------------------------------------------------

@query
def validate_telemetry(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return Q.validate_telemetry(A.with_nulls(A.with_constants(A.with_repeats(rows))), A.with_nulls(A.with_constants(rows)))


@query
def copy_compare(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return Q.compare_copies(rows, A.with_repeats(rows))


@query
def fingerprint_table(spark, sf_dir):
    return Q.fingerprint(telemetry(spark, sf_dir).select("sample_index", "cpu_percent", "cpu_temp_celsius", "core_id"))


@query
def fingerprint_groups(spark, sf_dir):
    return Q.fingerprint(telemetry(spark, sf_dir), by=["core_id"])


@query
def fingerprint_profile(spark, sf_dir):
    return Q.fingerprint(P.telemetry_profile(telemetry(spark, sf_dir)))


@query
def equal_within(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    keys = P.PROFILE_KEYS
    cells = Q.equal_within(P.profile(derive(rows)), P.profile(derive(rows, "float")), keys, rtol=1e-4, atol=1e-6)
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.count_if("equal").alias("equal_cells"))


@query
def small_groups(spark, sf_dir):
    return Q.small_groups(telemetry(spark, sf_dir), ["disk_write_mb", "net_recv_kb", "process_count"])


# --- experiment design -------------------------------------------------------

@query
def design_grid(spark, sf_dir):
    """The grid over the levels found in the log."""
    return D.design_grid(spark, anova.observed_levels(log(spark, sf_dir)))


@query
def block_schedule(spark, sf_dir):
    units = log(spark, sf_dir).select("config_id").distinct()
    return D.block_schedule(units, 10, seed=42)


@query
def block_schedule_lines(spark, sf_dir):
    """Every order placed in a shuffled position of each of three blocks."""
    units = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("unit")).distinct()
    return D.block_schedule(units, 3, seed=5, unit="unit")


@query
def pending_runs(spark, sf_dir):
    runs = log(spark, sf_dir).withColumn("block", F.col("block") + F.pmod(F.col("workers"), F.lit(3)) * 10)
    failing = runs.withColumn("status", F.when(F.col("energy_j") > 20000, F.col("status")).otherwise("error"))
    units = runs.select("config_id").distinct()
    return D.pending_runs(D.block_schedule(units, 20, seed=42), failing)


@query
def latest_state(spark, sf_dir):
    rows = log(spark, sf_dir).select("block", "config_id", "status", "timestamp", "energy_j", "runtime_s")
    return D.latest_state(rows)


@query
def select_configs(spark, sf_dir):
    wanted = {"engine": "A, R", "data_format": ["O"], "numeric_dtype": "", "execution_mode": None}
    kept = clean.select_configs(log(spark, sf_dir), wanted)
    return kept.groupBy("config_id").agg(F.count(F.lit(1)).alias("runs"))


@query
def check_design(spark, sf_dir):
    moved = F.when((F.col("block") == 3) & (F.col("engine") == "N"), 13).otherwise(F.col("block"))
    runs = design(spark, sf_dir).withColumn("block", moved)
    return D.check_design(runs, LEVELS, BLOCKS)


@query
def check_design_log(spark, sf_dir):
    return D.check_design(log(spark, sf_dir), {**LEVELS, "engine": ["A", "N", "X"]}, BLOCKS)


@query
def design_summary(spark, sf_dir):
    return D.design_summary(design(spark, sf_dir), LEVELS, BLOCKS)


@query
def check_levels(spark, sf_dir):
    return D.check_levels(log(spark, sf_dir), {**LEVELS, "engine": ["A", "N", "X"]})


@query
def check_workers(spark, sf_dir):
    return D.check_workers(log(spark, sf_dir))


@query
def failed_and_invalid_runs(spark, sf_dir):
    runs = log(spark, sf_dir)
    failed = clean.failed_runs(runs).select(F.lit("failed").alias("kind"), "config_id")
    bad = clean.invalid_outcomes(runs.withColumn("peak_rss_mb", F.col("peak_rss_mb") - 100), OUTCOMES)
    both = failed.unionByName(bad.select(F.lit("invalid").alias("kind"), "config_id"))
    return both.groupBy("kind", "config_id").agg(F.count(F.lit(1)).alias("runs"))


@query
def functional_audit(spark, sf_dir):
    return S.functional_audit(log(spark, sf_dir))


@query
def unstable_hashes(spark, sf_dir):
    return S.unstable_hashes(log(spark, sf_dir), 30)


# --- descriptive tables ------------------------------------------------------

@query
def describe_runs(spark, sf_dir):
    return rounded(S.describe(ok(spark, sf_dir)))


@query
def describe_design(spark, sf_dir):
    return rounded(S.describe(design(spark, sf_dir)))


@query
def config_summary(spark, sf_dir):
    return rounded(S.config_summary(design(spark, sf_dir)))


@query
def summarize_runs(spark, sf_dir):
    return rounded(S.summarize_runs(log(spark, sf_dir)))


@query
def engine_summary(spark, sf_dir):
    return rounded(S.engine_summary(ok(spark, sf_dir)))


@query
def main_effects(spark, sf_dir):
    return rounded(S.main_effects(ok(spark, sf_dir)))


@query
def block_summary(spark, sf_dir):
    return rounded(S.block_summary(ok(spark, sf_dir)))


@query
def interaction_means(spark, sf_dir):
    return rounded(S.interaction_means(ok(spark, sf_dir), "execution_mode", LEVELS["execution_mode"]))


@query
def factor_level_matrix(spark, sf_dir):
    return rounded(S.factor_level_matrix(ok(spark, sf_dir), LEVELS))


@query
def crosstab_workers(spark, sf_dir):
    return S.crosstab(log(spark, sf_dir), values=[1, 4])


@query
def best_worst(spark, sf_dir):
    return rounded(S.best_worst(ok(spark, sf_dir)))


@query
def top_bottom_k(spark, sf_dir):
    return rounded(S.top_bottom_k(S.config_means(ok(spark, sf_dir)), 10))


@query
def histogram(spark, sf_dir):
    return rounded(S.histogram(ok(spark, sf_dir), F.col("energy_j"), BINS))


@query
def histogram_log10(spark, sf_dir):
    return rounded(S.histogram(ok(spark, sf_dir), F.log10("energy_j"), BINS))


@query
def power_edp(spark, sf_dir):
    return S.with_power(log(spark, sf_dir)).select("config_id", "block", "avg_power_w", "edp_j_s")


@query
def derived_summary(spark, sf_dir):
    return rounded(S.derived_summary(ok(spark, sf_dir)))


@query
def carbon_totals(spark, sf_dir):
    return rounded(S.carbon_totals(ok(spark, sf_dir)))


@query
def carbon_by_config(spark, sf_dir):
    means = S.config_means(ok(spark, sf_dir))
    return rounded(S.with_carbon(means, "energy_mean").select("config_id", "co2_mg"))


@query
def scatter_bins(spark, sf_dir):
    return S.scatter_bins(ok(spark, sf_dir), "runtime_s", "energy_j", 32).select("x_bin", "y_bin", "n")


# --- models ------------------------------------------------------------------

def _no_p(table: DataFrame) -> DataFrame:
    # sums of squares are reported relative to the residual, whose size sets
    # their rounding error
    return rounded(table.select("term", "df", F.col("F").alias("f"), "partial_eta2"), 6)


@query
def type3_anova(spark, sf_dir):
    return _no_p(anova.effect_rows(anova.type3_anova(design(spark, sf_dir), ["energy_j"], LEVELS)))


@query
def type3_anova_outcomes(spark, sf_dir):
    """All outcomes in one job."""
    table = anova.effect_rows(anova.type3_anova(design(spark, sf_dir), OUTCOMES, LEVELS))
    return rounded(table.select("outcome", "term", "df", F.col("F").alias("f"), "partial_eta2"))


@query
def type3_anova_p(spark, sf_dir):
    table = anova.effect_rows(anova.type3_anova(design(spark, sf_dir), OUTCOMES, LEVELS))
    return rounded(table.select("outcome", "term", "df", "p_value"))


@query
def type3_unbalanced(spark, sf_dir):
    return _no_p(anova.effect_rows(anova.type3_anova(ok(spark, sf_dir), ["energy_j"], LEVELS, block=None)))


@query
def type3_unbalanced_blocks(spark, sf_dir):
    """Every row of the table, the constant included; sizes as logarithms."""
    table = anova.type3_anova(ok(spark, sf_dir), OUTCOMES, LEVELS, block="block")
    return rounded(table.select("outcome", "term", "df", F.log10("sum_sq").alias("log_ss"), F.log10("F").alias("log_f"), "p_value", "partial_eta2"),
                   {"log_ss": 5, "log_f": 5})


@query
def partial_eta2_ranked(spark, sf_dir):
    table = anova.ranked_effects(anova.type3_anova(design(spark, sf_dir), ["energy_j"], LEVELS))
    return rounded(table.select("term", "partial_eta2", "eta2_interpretation"))


@query
def model_fit(spark, sf_dir):
    fit = anova.model_fit(design(spark, sf_dir), ["energy_j"], LEVELS)
    return rounded(fit.select("n", "df_resid", "r_squared", "rmse"))


@query
def residuals(spark, sf_dir):
    rows = anova.residuals(design(spark, sf_dir), "energy_j", LEVELS)
    return rounded(rows.select("block", "config_id", "fitted", "residual"), 5)


@query
def interpretation(spark, sf_dir):
    runs = design(spark, sf_dir)
    return rounded(anova.interpretation(runs, anova.type3_anova(runs, ["energy_j"], LEVELS)))


# --- diagnostics -------------------------------------------------------------

def _statistic(table: DataFrame) -> DataFrame:
    return rounded(table.select("statistic", "df1", "df2", "p_value"))


@query
def levene(spark, sf_dir):
    return _statistic(G.levene(ok(spark, sf_dir), "energy_j"))


@query
def brown_forsythe(spark, sf_dir):
    return _statistic(G.levene(ok(spark, sf_dir), "energy_j", center="median"))


@query
def shapiro_wilk(spark, sf_dir):
    return rounded(G.shapiro_wilk(anova.residuals(design(spark, sf_dir), "energy_j", LEVELS)))


@query
def shapiro_wilk_log(spark, sf_dir):
    return rounded(G.shapiro_wilk(ok(spark, sf_dir), "energy_j"))


@query
def qq_points(spark, sf_dir):
    return rounded(G.qq_points(ok(spark, sf_dir), "energy_j"))


@query
def qq_samples(spark, sf_dir):
    """Positions and standardised values of the Q-Q plot."""
    return rounded(G.qq_points(ok(spark, sf_dir), "energy_j").select("position", "sample"))


@query
def assumption_summary(spark, sf_dir):
    return rounded(G.assumption_summary(design(spark, sf_dir), OUTCOMES, LEVELS))


@query
def tail_p(spark, sf_dir):
    """P(F > f) from 1e3 to 1e13 degrees of freedom."""
    groups = lineitem(spark, sf_dir).groupBy("l_linenumber", "l_returnflag").agg((F.avg("l_quantity") / 10).alias("f"))
    df1 = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(7.0)
    df2 = F.pow(F.lit(10.0), 3 + 10 * (F.col("l_linenumber") - 1) / 6.0)
    return rounded(groups.select("l_linenumber", "l_returnflag", f_tail("f", df1, df2).alias("p_value")), 9)


# --- aligned ranks -----------------------------------------------------------

@query
def art_anova(spark, sf_dir):
    return _no_p(art.art_anova(design(spark, sf_dir), "energy_j", LEVELS))


@query
def art_anova_secondary(spark, sf_dir):
    out = None
    for c in OUTCOMES[1:]:
        table = _no_p(art.art_anova(design(spark, sf_dir), c, LEVELS)).withColumn("outcome", F.lit(c))
        out = table if out is None else out.unionByName(table)
    return out


@query
def art_mixed(spark, sf_dir):
    """Blocks as a random effect, for all outcomes."""
    out = None
    for c in OUTCOMES:
        table = _no_p(art.art_anova(design(spark, sf_dir), c, LEVELS, block_model="mixed")).withColumn("outcome", F.lit(c))
        out = table if out is None else out.unionByName(table)
    return out


@query
def art_unbalanced(spark, sf_dir):
    """The whole log: cells and blocks of any size."""
    return _no_p(art.art_anova(ok(spark, sf_dir), "energy_j", LEVELS))


@query
def art_anova_p(spark, sf_dir):
    return rounded(art.art_anova(design(spark, sf_dir), "energy_j", LEVELS).select("term", "df", "p_value"))


@query
def art_alignment_check(spark, sf_dir):
    """Sums of squares as shares of the term's own in the raw outcome."""
    runs = design(spark, sf_dir)
    own = anova.type3_anova(runs, ["energy_j"], LEVELS).select(F.col("term").alias("target"), "sum_sq")
    table = art.art_alignment_check(runs, "energy_j", LEVELS).join(own, "target")
    share = lambda c: (F.col(c) / F.col("sum_sq"))
    return rounded(table.select("target", (F.col("aligned_sum") / 1e4).alias("aligned_sum"), share("target_sum_sq").alias("target_share"),
                                share("largest_other_sum_sq").alias("largest_other_share"), "ok"), 3)


@query
def artc_engine_pairwise(spark, sf_dir):
    table = art.artc_pairwise(design(spark, sf_dir), ["engine"], "energy_j", LEVELS)
    return rounded(table.select("contrast", "estimate", "se", "df", "t_ratio"))


@query
def artc_engine_pairwise_holm(spark, sf_dir):
    table = art.artc_pairwise(design(spark, sf_dir), ["engine"], "energy_j", LEVELS)
    return rounded(table.select("contrast", "p_value", "p_holm"))


def _within(spark, sf_dir) -> DataFrame:
    runs = design(spark, sf_dir)
    out = None
    for f in BINARY:
        table = art.artc_within(runs, f, "engine", "energy_j", LEVELS).withColumn("factor", F.lit(f))
        out = table if out is None else out.unionByName(table)
    return out


@query
def artc_within_engine(spark, sf_dir):
    return rounded(_within(spark, sf_dir).select("factor", "engine", "contrast", "estimate", "se", "df", "t_ratio"))


@query
def artc_within_engine_holm(spark, sf_dir):
    """With p values, raw and adjusted."""
    return rounded(_within(spark, sf_dir).select("factor", "engine", "contrast", "p_value", "p_holm"))


@query
def holm_adjust(spark, sf_dir):
    """Adjusts one stand-in p value per (engine, configuration)."""
    cells = ok(spark, sf_dir).groupBy("engine", "config_id").agg(
        ((F.sum("runtime_s").cast("bigint") % 997).cast("double") / 20000.0).alias("p_value"))
    return rounded(art.holm(cells, "p_value", ["engine"]))


# --- relations ---------------------------------------------------------------

@query
def corr_pearson(spark, sf_dir):
    return rounded(R.pearson(ok(spark, sf_dir), "energy_j", "runtime_s"))


@query
def corr_spearman(spark, sf_dir):
    return rounded(R.spearman(ok(spark, sf_dir), "energy_j", "runtime_s"))


@query
def correlations(spark, sf_dir):
    return rounded(R.correlations(ok(spark, sf_dir)).drop("p_value"))


@query
def correlations_p(spark, sf_dir):
    return rounded(R.correlations(ok(spark, sf_dir)).drop("statistic"))


@query
def average_ranks(spark, sf_dir):
    from tallywatt.plans.ranks import value_ranks

    return value_ranks(ok(spark, sf_dir), "runtime_s", ["engine"]).select(
        "engine", "value", "n", "min_rank", "avg_rank", "total")


@query
def pareto_2d(spark, sf_dir):
    runs = ok(spark, sf_dir).select("config_id", "block", "energy_j", "runtime_s")
    flagged = R.pareto(runs, ["energy_j", "runtime_s"])
    return flagged.filter("pareto")


@query
def pareto_3d(spark, sf_dir):
    runs = ok(spark, sf_dir).withColumn("slack", -F.col("runtime_s")).select("config_id", "block", "energy_j", "slack", "peak_rss_mb")
    return R.pareto(runs, ["energy_j", "slack", "peak_rss_mb"]).filter("pareto")


@query
def pareto_configs(spark, sf_dir):
    return R.pareto_table(design(spark, sf_dir)).select(
        "config_id", "pareto_energy_runtime", "pareto_energy_runtime_memory")


@query
def position_drift(spark, sf_dir):
    runs = D.block_positions(design(spark, sf_dir), seed=0)
    table = R.position_drift(anova.residuals(runs, "energy_j", LEVELS))
    return rounded(table.select("n", "spearman_rho", "p_value"))


@query
def leave_one_block_out(spark, sf_dir):
    return rounded(R.leave_one_block_out(ok(spark, sf_dir)))


@query
def best_stability(spark, sf_dir):
    return R.best_stability(R.leave_one_block_out(ok(spark, sf_dir)))
