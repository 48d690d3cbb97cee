"""Descriptive tables of a run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywatt.functions.dist_columns import t_quantile
from tallywatt.functions.values import GRID_KG_PER_KWH, JOULES_PER_KWH, carbon_grams
from tallywatt.plans.selection import medians, quantile_table
from tallywatt.schema import FACTORS, OUTCOMES

CONFIG = ("config_id", *FACTORS)
SHORT = {"energy_j": "energy", "runtime_s": "runtime", "peak_rss_mb": "memory"}


def numbered(summary: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Unique rank 1..n of a summary table.

    The window has no partition: it is for tables with one row per
    configuration, whose size the declared levels bound.
    """
    return summary.withColumn(name, F.row_number().over(W.orderBy(*order)))


def confidence(summary: DataFrame, prefix: str = "energy", level: float = 0.95) -> DataFrame:
    """Standard error, t quantile, interval and CV% beside mean, sd and n."""
    mean, sd, n = F.col(f"{prefix}_mean"), F.col(f"{prefix}_sd"), F.col("n")
    tag = f"{level * 100:.0f}"
    t, se = F.col(f"t_crit_{tag}"), F.col(f"{prefix}_se")
    return (
        summary.withColumn(f"{prefix}_se", sd / F.sqrt(n))
        .withColumn(f"t_crit_{tag}", t_quantile(0.5 + level / 2, n - 1))
        .withColumns({f"{prefix}_ci{tag}_low": mean - t * se, f"{prefix}_ci{tag}_high": mean + t * se,
                      f"{prefix}_cv_percent": F.try_divide(100 * sd, mean)})
    )


def config_summary(runs: DataFrame, keys: Sequence[str] = CONFIG, tie: str = "config_id") -> DataFrame:
    """Per configuration: n, centre and spread of the outcomes, the 95%
    interval of mean energy, and the energy rank.
    """
    stats = [
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{short}_{name}") for c, short in SHORT.items()
          for name, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        F.min("energy_j").alias("energy_min"),
        F.max("energy_j").alias("energy_max"),
    ]
    table = medians(runs, OUTCOMES, keys, extra=stats)
    table = confidence(table.withColumnsRenamed({f"{c}_median": f"{short}_median" for c, short in SHORT.items()}))
    return numbered(table, [F.col("energy_mean").asc_nulls_last(), F.col(tie)], "energy_rank")


def summarize_runs(runs: DataFrame) -> DataFrame:
    """Ten statistics per configuration of the ok rows, ranked by energy,
    then runtime, nulls last; null factors keep their own group.
    """
    mode = "execution_mode" if "execution_mode" in runs.columns else "threading_mode"
    keys = [*FACTORS[:4], mode, "config_id"]
    ok = runs.filter("status = 'ok'")
    stats = [
        *[f(c).alias(f"{c}_{name}") for c in OUTCOMES for name, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.count("block").alias("measured_runs"),
    ]
    table = medians(ok, OUTCOMES, keys, extra=stats)
    order = [F.col("energy_j_mean").asc_nulls_last(), F.col("runtime_s_mean").asc_nulls_last(), F.col("config_id")]
    return numbered(table, order, "energy_rank")


def _six(prefix_first: bool) -> dict[str, Column]:
    name = (lambda a, b: f"{a}_{b}") if prefix_first else (lambda a, b: f"{b}_{a}")
    return {
        "n": F.count(F.lit(1)),
        name("energy", "mean"): F.avg("energy_j"),
        name("energy", "sd"): F.stddev_samp("energy_j"),
        name("runtime", "mean"): F.avg("runtime_s"),
        name("memory", "mean"): F.avg("peak_rss_mb"),
    }


def engine_summary(runs: DataFrame, by: str = "engine") -> DataFrame:
    """Six statistics per engine, lowest mean energy first."""
    table = medians(runs, ["energy_j"], [by], extra=[c.alias(n) for n, c in _six(False).items()])
    return table.withColumnRenamed("energy_j_median", "median_energy").orderBy("mean_energy")


def by_factor_level(runs: DataFrame, factors: Sequence[str], *cols: str) -> DataFrame:
    """(factor, level, cols): each row once per factor."""
    pairs = [F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors]
    return runs.select(*cols, F.inline(F.array(*pairs)))


def main_effects(runs: DataFrame, factors: Sequence[str] = tuple(FACTORS[1:])) -> DataFrame:
    """Six statistics per level of every factor, one grouping for all."""
    long = by_factor_level(runs, factors, *OUTCOMES)
    keys = ["factor", "level"]
    table = medians(long, ["energy_j"], keys, extra=[c.alias(n) for n, c in _six(True).items()])
    return table.withColumnRenamed("energy_j_median", "energy_median")


def interaction_means(runs: DataFrame, factor: str, levels: Sequence[str] | None = None,
                      outcome: str = "energy_j", by: str = "engine") -> DataFrame:
    """Mean outcome per engine (rows) and factor level (columns)."""
    return runs.groupBy(by).pivot(factor, list(levels) if levels else None).agg(F.avg(outcome))


def factor_level_matrix(runs: DataFrame, levels: Mapping[str, Sequence[str]], outcome: str = "energy_j",
                        by: str = "engine") -> DataFrame:
    """Mean outcome per engine: overall and for every factor level.

    Rows are reduced to full cells first; the grouping sets then expand the
    cells, not the log.
    """
    factors = [f for f in levels if f != by]
    cells = runs.groupBy(by, *factors).agg(F.sum(outcome).alias("s"), F.count(outcome).alias("n"))

    def mean_where(test: Column | None) -> Column:
        pick = (lambda c: F.col(c)) if test is None else (lambda c: F.when(test, F.col(c)))
        return F.try_divide(F.sum(pick("s")), F.sum(pick("n")))

    columns = [mean_where(None).alias("overall")]
    columns += [mean_where(F.col(f) == v).alias(f"{f}_{v}") for f in factors for v in levels[f]]
    return cells.groupBy(by).agg(*columns)


def block_summary(runs: DataFrame) -> DataFrame:
    stats = [F.avg("energy_j").alias("energy_mean"), F.avg("runtime_s").alias("runtime_mean"), F.avg("peak_rss_mb").alias("memory_mean")]
    return medians(runs, ["energy_j"], ["block"], extra=stats).withColumnRenamed("energy_j_median", "energy_median")


def functional_audit(runs: DataFrame) -> DataFrame:
    """Distinct input counts, output counts and result hashes per config."""
    return runs.groupBy("config_id").agg(
        F.count_distinct("rows_in").alias("n_unique_rows_in"),
        F.count_distinct("rows_out").alias("n_unique_rows_out"),
        F.count_distinct("result_hash").alias("n_unique_hashes"),
    )


def unstable_hashes(runs: DataFrame, k: int | None = None) -> DataFrame:
    """Configurations with more than one hash; ``k`` for a top-k report."""
    found = functional_audit(runs).filter("n_unique_hashes > 1")
    return found if k is None else found.orderBy(F.desc("n_unique_hashes"), "config_id").limit(k)


def describe(df: DataFrame, cols: Sequence[str] = OUTCOMES) -> DataFrame:
    """Count, mean, std, minimum, quartiles, maximum, median and CV%."""
    stats = [f(c).alias(f"{c}__{n}") for c in cols for n, f in (
        ("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    table = quantile_table(df, cols, [0.25, 0.5, 0.75], extra=stats)
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("count"), F.col(f"{c}__mean").alias("mean"),
                 F.col(f"{c}__sd").alias("std"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                 *[F.col(f"q_{i}_{j}").alias(p) for j, p in enumerate(("p25", "p50", "p75"))])
        for i, c in enumerate(cols)
    ]
    return table.select(F.inline(F.array(*entries))).withColumns(
        {"median": F.col("p50"), "cv_percent": F.try_divide(100 * F.col("std"), F.col("mean"))})


def crosstab(runs: DataFrame, row: str = "execution_mode", col: str = "workers",
             values: Sequence | None = None) -> DataFrame:
    table = runs.groupBy(row).pivot(col, list(values) if values else None).count()
    return table.fillna(0)


def with_power(runs: DataFrame) -> DataFrame:
    """Average power (W) and energy-delay product (J s) per run."""
    return runs.withColumns({"avg_power_w": F.try_divide("energy_j", "runtime_s"),
                             "edp_j_s": F.col("energy_j") * F.col("runtime_s")})


def derived_summary(runs: DataFrame, keys: Sequence[str] = CONFIG) -> DataFrame:
    return with_power(runs).groupBy(*keys).agg(
        F.avg("energy_j").alias("mean_energy"), F.avg("runtime_s").alias("mean_runtime"),
        F.avg("peak_rss_mb").alias("mean_memory"), F.avg("avg_power_w").alias("mean_power"),
        F.avg("edp_j_s").alias("mean_edp"),
    ).orderBy("mean_energy")


def config_means(runs: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.avg(c).alias(f"{short}_mean") for c, short in SHORT.items()])


def best_worst(runs: DataFrame) -> DataFrame:
    """One row: the lowest and highest mean-energy configuration, ratios and
    percentage reductions. Ties go to the smaller id at either end.
    """
    row = F.struct("energy_mean", "config_id", "runtime_mean", "memory_mean")
    table = config_means(runs).agg(
        F.min(row).alias("best"),
        F.min_by(row, F.struct(-F.col("energy_mean"), "config_id")).alias("worst"),
    )
    b, w = (lambda c: F.col(f"best.{c}_mean")), (lambda c: F.col(f"worst.{c}_mean"))
    return table.select(
        F.col("best.config_id").alias("best_config"), F.col("worst.config_id").alias("worst_config"),
        *[b(c).alias(f"best_{c}_mean") for c in ("energy", "runtime", "memory")],
        *[w(c).alias(f"worst_{c}_mean") for c in ("energy", "runtime", "memory")],
        *[F.try_divide(w(c), b(c)).alias(f"{c}_ratio") for c in ("energy", "runtime")],
        *[(100 * (1 - F.try_divide(b(c), w(c)))).alias(f"{c}_reduction_pct") for c in ("energy", "runtime")],
    )


def top_bottom_k(summary: DataFrame, k: int = 10, by: str = "energy_mean", tie: str = "config_id") -> DataFrame:
    """The k lowest and the k highest rows of a summary, labelled."""
    low = summary.orderBy(F.col(by).asc_nulls_last(), tie).limit(k).withColumn("side", F.lit("lowest"))
    high = summary.orderBy(F.col(by).desc_nulls_last(), tie).limit(k).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def histogram(df: DataFrame, value: Column, bins: int = 40) -> DataFrame:
    """Counts of equal-width bins from minimum to maximum, empty ones kept.

    Only the two range ends reach the driver. The bin index is corrected
    against the printed edges, so a value always lies inside its bin.
    """
    values = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, n bigint")
    lo, hi = ends["lo"], ends["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(hi)).otherwise(i * F.lit(step) + F.lit(lo))

    raw = F.floor((F.col("v") - lo) / (hi - lo) * bins)
    i = F.least(raw, F.lit(bins - 1)).cast("int")
    values = values.withColumn("i", i)
    fixed = F.when(F.col("v") < edge(F.col("i")), F.col("i") - 1).when(
        (F.col("v") >= edge(F.col("i") + 1)) & (F.col("i") != bins - 1), F.col("i") + 1).otherwise(F.col("i"))
    counts = values.groupBy(fixed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left")
    return out.select("bin", edge(F.col("bin")).alias("bin_low"), edge(F.col("bin") + 1).alias("bin_high"),
                      F.coalesce("n", F.lit(0)).alias("n"))


def with_carbon(df: DataFrame, energy: str = "energy_j", kg_per_kwh: float = GRID_KG_PER_KWH) -> DataFrame:
    return df.withColumn("co2_mg", carbon_grams(F.col(energy), kg_per_kwh) * 1000.0)


def carbon_totals(runs: DataFrame, kg_per_kwh: float = GRID_KG_PER_KWH) -> DataFrame:
    """Totals over all runs and the CO2 of the lowest, mean, median and
    highest energy per run."""
    totals = [
        F.count("energy_j").alias("runs"), F.sum("energy_j").alias("total_j"), F.avg("energy_j").alias("mean_j"),
        F.min("energy_j").alias("min_j"), F.max("energy_j").alias("max_j")]
    one = medians(runs, ["energy_j"], [], extra=totals).withColumnRenamed("energy_j_median", "median_j")
    mg = lambda c: carbon_grams(F.col(c), kg_per_kwh) * 1000.0
    return one.select(
        "runs", (F.col("total_j") / 1000.0).alias("total_kj"), (F.col("total_j") / JOULES_PER_KWH).alias("total_kwh"),
        carbon_grams(F.col("total_j"), kg_per_kwh).alias("total_co2_g"), "mean_j", "median_j",
        mg("min_j").alias("co2_mg_min"), mg("median_j").alias("co2_mg_median"),
        mg("mean_j").alias("co2_mg_mean"), mg("max_j").alias("co2_mg_max"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """Plot data of a scatter: counts on a bins x bins grid over the ranges,
    at most bins^2 rows however large the table."""
    r = df.agg(*[f(c).cast("double") for c in (x, y) for f in (F.min, F.max)]).first()

    def cell(c: str, lo: float | None, hi: float | None) -> Column:
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")

    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        cell(x, r[0], r[1]).alias("x_bin"), cell(y, r[2], r[3]).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))
